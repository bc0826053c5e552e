"""One query per operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, dedup, inner_product, language, mixing, near_dups, sharding, token_counts, token_files, url_rules
from corvane.sources import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


SHARD_NAMES = [f"shard-{i:02d}" for i in range(sharding.SHARDS)]

OP1_SQL = f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({sharding.SHARDS}) r(i)),
walks AS (SELECT list(('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % {sharding.SLOTS} ORDER BY i) AS offs,
                 list(('0x' || substr(md5('skip:' || name), 1, 15))::BIGINT % {sharding.SLOTS - 1} + 1 ORDER BY i) AS skips FROM names),
fill(turn, owner) AS (
  SELECT 0, list_transform(range({sharding.SLOTS}), lambda k: -1)
  UNION ALL
  SELECT turn + 1, list_transform(range({sharding.SLOTS}), lambda k: CASE WHEN k = pick THEN turn % {sharding.SHARDS} ELSE owner[k + 1] END)
  FROM (SELECT turn, owner, list_filter(list_transform(range({sharding.SLOTS}), lambda j: (offs[turn % {sharding.SHARDS} + 1] + j * skips[turn % {sharding.SHARDS} + 1]) % {sharding.SLOTS}), lambda s: owner[s + 1] = -1)[1] AS pick
        FROM fill, walks WHERE turn < {sharding.SLOTS})
),
slots AS (SELECT unnest(range({sharding.SLOTS})) AS slot, unnest(owner) AS owner FROM fill WHERE turn = {sharding.SLOTS}),
placed AS (SELECT doc_id, ('0x' || substr(md5('key:' || length(doc_id::VARCHAR) || ':' || doc_id), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, placed.slot::INTEGER AS slot, name AS shard FROM placed JOIN slots USING (slot) JOIN names ON names.i = slots.owner
"""


@query(OP1_SQL)
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARD_NAMES)


RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def bpe_digests(documents: DataFrame) -> DataFrame:
    coded = bpe.round_trip(documents, RANK_FILE, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), WORD_TOKENIZER))


OP6_SQL = r"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT count(*) FROM documents) / (SELECT count(*) FROM counts) / n AS rate FROM counts),
pieces AS (SELECT source, rate, greatest(1, ceil(rate / 64))::INTEGER AS pieces FROM rates),
cdf AS (SELECT source, pieces, k, sum(exp(k * ln(rate / pieces) - rate / pieces - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
        FROM pieces, range(900) r(k) WHERE k <= ceil(rate / pieces + 12 * sqrt(rate / pieces) + 20)),
numbered AS (SELECT d.doc_id, d.source, unnest(range(1, p.pieces + 1)) AS i FROM documents d JOIN pieces p USING (source)),
draws AS (SELECT *, ('0x' || substr(md5('mix:' || i || ':' || doc_id), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u FROM numbered),
drawn AS (SELECT doc_id, sum((SELECT count(*) FROM cdf WHERE cdf.source = draws.source AND cdf.c <= u))::INTEGER AS copies FROM draws GROUP BY doc_id)
SELECT doc_id, text, lang, source, n_chars, copies, copy_no::INTEGER AS copy_no, ('0x' || substr(md5('mix:order:' || copy_no || ':' || doc_id), 1, 15))::BIGINT AS order_key
FROM (SELECT d.*, copies, unnest(range(1, copies + 1)) AS copy_no FROM documents d JOIN drawn USING (doc_id))
"""


@query(OP6_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT norm, count(*) AS group_size, (list(doc_id ORDER BY n DESC, doc_id))[1] AS keep_id FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN w USING (norm)
"""


@query(OP7_SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

OP10_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
        FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND k = 1
"""


@query(OP10_SQL)
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.rule_table(spark, URL_RULES))


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), RANK_FILE, public_tokenizers.PATTERN)


@query()
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query()
def op5_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.search(table(spark, sf_dir, "embeddings"))


@query()
def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_dups(table(spark, sf_dir, "documents").select("doc_id", "text"))
