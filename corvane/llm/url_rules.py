"""URL filters by a sort-merge range join (operator 10, DataFrame operations only).

A rule (host, path prefix) becomes the interval of all canonical keys that begin with its own key; a key is the host
with its labels reversed, a U+0000, and the path. A rule also covers subdomains, so a page offers one key for its host
and one for each parent domain that has no more labels than the longest rule host: longer ones fit no rule. Intervals
nest or are disjoint. Walking the rules of a host in key order with a stack of the rules still open gives each rule the
one below it on the stack; that turns intervals into boundaries at which the innermost open rule changes. The walk goes
by chunks of CHUNK rules; what is open where a chunk begins is found by a walk over the chunks before it, so a host may
have CHUNK times as many rules as an array of chunks can hold. Pages and boundaries are then merged in key order, each
page taking the rule of the last boundary before it. A host with many pages is swept by salts, one for every SPREAD
pages, or for as many pages as the host has boundaries where these are more: the copies of boundaries never exceed pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut

SPREAD, CHUNK = 20_000, 1024
#: Above every byte of UTF-8: what closes an interval after all keys that begin with the rule's own.
TOP = "FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
RULE_TYPE = "struct<key:string,verdict:string,rule:string,host_len:int>"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """verdict, host, path from a list in the program; any DataFrame of these columns will do as well."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("verdict"), F.lit("").alias("host"), F.lit("").alias("path"))
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])))


def _clean(rules: DataFrame) -> DataFrame:
    return rules.select("verdict", F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))


def boundaries(rules: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rhost, key, rule: from key on, rule is the innermost open one, null for none.

    Of two rules with the same host and path, block comes before allow.
    """
    clean = _clean(rules).select(
        reversed_host(F.col("host")).alias("rhost"),
        F.struct(
            F.concat(reversed_host(F.col("host")), F.lit("\0"), F.col("path")).alias("key"), "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_len")
        ).cast(RULE_TYPE).alias("rule"),
    )
    clean = clean.groupBy("rhost", "rule.key").agg(F.max_by("rule", "rule.verdict").alias("rule"))
    place = F.row_number().over(Window.partitionBy("rhost").orderBy(F.col("key").cast("binary")))
    chunks = clean.withColumn("chunk", F.floor((place - 1) / chunk)).groupBy("rhost", "chunk").agg(F.array_sort(F.collect_list("rule")).alias("rules"))

    def open_at(stack: Column, key: Column) -> Column:
        return F.filter(stack, lambda x: key.startswith(x["key"]))

    def innermost(stack: Column) -> Column:
        return F.element_at(F.concat(F.array(F.lit(None).cast(RULE_TYPE)), stack), -1)

    def next_rule(acc: Column, r: Column) -> Column:
        still = open_at(acc["stack"], r["key"])
        return F.struct(F.concat(still, F.array(r)).alias("stack"), F.concat(acc["out"], F.array(F.struct(r.alias("rule"), innermost(still).alias("below")))).alias("out"))

    def next_chunk(acc: Column, c: Column) -> Column:
        before = open_at(acc["stack"], c["first"])
        return F.struct(F.concat(before, c["stack"]).alias("stack"), F.concat(acc["out"], F.array(F.struct(c["chunk"].alias("chunk"), before.alias("before")))).alias("out"))

    nothing = F.array().cast(f"array<{RULE_TYPE}>").alias("stack")
    start = F.struct(nothing, F.array().cast(f"array<struct<rule:{RULE_TYPE},below:{RULE_TYPE}>>").alias("out"))
    walked = cut(chunks.select("rhost", "chunk", F.col("rules")[0]["key"].alias("first"), F.aggregate("rules", start, next_rule).alias("w")), "rule_chunks")
    start = F.struct(nothing, F.array().cast(f"array<struct<chunk:long,before:array<{RULE_TYPE}>>>").alias("out"))
    listed = walked.groupBy("rhost").agg(F.array_sort(F.collect_list(F.struct("chunk", "first", "w.stack"))).alias("c"))
    befores = listed.select("rhost", F.explode(F.aggregate("c", start, next_chunk)["out"]).alias("b")).select("rhost", "b.chunk", "b.before")
    opened = walked.join(befores, ["rhost", "chunk"]).select("rhost", "before", F.explode("w.out").alias("o"))
    opened = opened.select("rhost", "o.rule", F.coalesce("o.below", innermost(open_at(F.col("before"), F.col("o.rule.key")))).alias("below"))
    key = F.col("rule.key").cast("binary")
    return opened.select("rhost", key.alias("key"), "rule").unionByName(opened.select("rhost", F.concat(key, F.unhex(F.lit(TOP))).alias("key"), F.col("below").alias("rule")))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", spread: int = SPREAD, chunk: int = CHUNK) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict.

    The longest fitting rule (host and path together) wins, then the one with the longer host. Null or unparsable urls
    have an empty host and path, and like every page without a rule they are allowed. Urls of any length are judged
    whole, in time and memory that grow with their length (times the labels of the longest rule host). Rows that repeat
    an id are judged each by itself. An empty table gives no rows; columns of pages other than these two are ignored.
    """
    most = rules.select(F.size(F.split(F.coalesce("host", F.lit("")), r"\.")).alias("n")).agg(F.max("n")).first()[0] or 1
    parsed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    edges = cut(boundaries(rules, chunk), "boundaries")
    hosts = cut(edges.groupBy("rhost").agg(F.count(F.lit(1)).alias("edges")), "rule_hosts")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda i: F.array_join(F.reverse(F.slice(labels, -i, i)), "."))
    offered = parsed.select("id", "host", "path", F.xxhash64("id", "host", "path").alias("h"), F.explode(parents).alias("rhost"))
    salts = F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(spread), F.any_value("edges"))).cast("int")
    salted = cut(offered.select("rhost").join(hosts, "rhost").groupBy("rhost").agg(salts.alias("salts")), "rule_salts")
    offered = offered.join(salted, "rhost").select("rhost", F.pmod("h", F.col("salts")).cast("int").alias("salt"), F.concat("rhost", F.lit("\0"), "path").cast("binary").alias("key"), "id", "host", "path")
    spread_edges = edges.join(salted, "rhost").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    swept = spread_edges.withColumn("is_page", F.lit(False)).unionByName(offered.withColumn("is_page", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("rhost", "salt").orderBy("key", "is_page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A boundary that closes the last rule has a null rule: wrapped, so that it also ends the one before.
    top = F.last(F.when(~F.col("is_page"), F.struct("rule")), ignorenulls=True).over(order)["rule"]
    hits = swept.withColumn("top", top).where(F.col("is_page") & F.col("top").isNotNull())
    rank = F.struct(F.length("top.rule").alias("len"), F.col("top.host_len").alias("host_len"), F.col("top.rule").alias("rule"))
    best = hits.groupBy("id", "host", "path").agg(F.max_by("top", rank).alias("top"))
    same = F.col("p.id").eqNullSafe(F.col("b.id")) & (F.col("p.host") == F.col("b.host")) & (F.col("p.path") == F.col("b.path"))
    return parsed.alias("p").join(best.alias("b"), same, "left").select(
        F.col("p.id").alias(id_col), "p.host", "p.path", F.col("b.top.rule").alias("rule"), F.coalesce("b.top.verdict", F.lit(DEFAULT)).alias("verdict")
    )
