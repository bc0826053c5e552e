"""Queries of the retrieval operators: terms, lanes, fusion, reranking, answer state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import lanes as L
from corvane.operators import postings as P
from corvane.operators import rank as R
from corvane.plans import sqltext as S
from corvane.plans.registry import query
from corvane.sources import table


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def hits(spark: SparkSession, d: str, best: int | None = None) -> DataFrame:
    """best: how deep the lanes over these hits go; only for lanes, never where hits are counted."""
    return P.question_hits(table(spark, d, "documents"), "doc_id", "text", P.query_terms(questions(spark, d)), best)


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """One question per label: the mean of its vectors."""
    flat = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(F.col("label").alias("qid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("qv"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", V.as_double(F.col("embedding")).alias("v"))


@query("tokenize_terms", f"SELECT item_id, {S.terms('text')} AS terms, {S.content('text')} AS content FROM benchmark")
def tokenize_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.terms(F.col("text")).alias("terms"), T.content_terms(F.col("text")).alias("content"))


@query("quoted_phrases", """SELECT conv_id, turn, list_transform(regexp_extract_all(text, '"([^"]+)"', 1), lambda p: lower(trim(p))) AS phrases FROM conversations""")
def quoted_phrases(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.phrases(F.col("text")).alias("phrases"))


@query("term_document_frequency", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY term")
def term_document_frequency(spark, d):
    return P.document_frequency(table(spark, d, "documents"), "text")


@query("stem_document_frequency", f"""WITH df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY term)
SELECT stem, max(df) AS df FROM ({S.stem('df')}) GROUP BY stem""")
def stem_document_frequency(spark, d):
    return P.stem_frequency(table(spark, d, "documents"), "text")


@query("surface_term_statistics", f"""WITH df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY term),
s AS ({S.stem('df')})
SELECT stem, count(*) AS n_terms, string_agg(term, ' & ' ORDER BY term) AS fragment, min(df) AS min_df FROM s GROUP BY stem""")
def surface_term_statistics(spark, d):
    df = P.document_frequency(table(spark, d, "documents"), "text")
    return P.stemmed(df).groupBy("stem").agg(F.count(F.lit(1)).alias("n_terms"), F.array_join(F.sort_array(F.collect_list("term")), " & ").alias("fragment"), F.min("df").alias("min_df"))


@query("df_probe_capped", f"""WITH {S.query_terms(12)},
e AS (SELECT term, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY term),
n AS (SELECT term, count(DISTINCT page_id) AS n FROM (SELECT page_id, unnest({S.terms('html')}) AS term FROM pages) GROUP BY term)
SELECT term, least(coalesce(e.n, 0), 5000) + least(coalesce(n.n, 0), 5000) AS df FROM (SELECT DISTINCT term FROM qt) LEFT JOIN e USING (term) LEFT JOIN n USING (term)""")
def df_probe_capped(spark, d):
    asked = P.query_terms(questions(spark, d), 12).select("term").distinct()
    count = lambda t, x: P.document_frequency(table(spark, d, t), x, asked)
    e, n = count("documents", "text").withColumnRenamed("df", "e"), count("pages", "html").withColumnRenamed("df", "n")
    bounded = lambda c: F.least(F.coalesce(c, F.lit(0)), F.lit(5000))
    return asked.join(e, "term", "left").join(n, "term", "left").select("term", (bounded("e") + bounded("n")).alias("df"))


@query("lane_and_topk", f"WITH {S.HITS}, {S.ranked('hits', 'matched = n_terms', 24, 'lane')} SELECT qid, id, score, rnk::INTEGER AS rnk FROM lane")
def lane_and_topk(spark, d):
    return L.and_lane(hits(spark, d, 24), 24)


@query("lane_or_fragment_topk", f"WITH {S.HITS}, {S.ranked('hits', 'matched >= least(2, n_terms)', 24, 'lane')} SELECT qid, id, score, rnk::INTEGER AS rnk FROM lane")
def lane_or_fragment_topk(spark, d):
    return L.or_lane(hits(spark, d, 24), 24)


TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


@query("exact_title", f"""WITH n AS (SELECT page_id, {TITLE} AS title FROM pages) SELECT a.page_id AS qid, b.page_id AS id FROM n a JOIN n b ON lower(regexp_replace('"' || a.title || '"', '^"(.*)"$', '\\1')) = lower(b.title)""")
def exact_title(spark, d):
    n = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return L.exact_title(n.select(F.col("page_id").alias("qid"), F.concat(F.lit('"'), "title", F.lit('"')).alias("text")), n.select(F.col("page_id").alias("id"), "title"))


@query("lane_vector_topk", f"WITH {S.VECTOR_SCORED}, {S.ranked('scored', 'score >= 0.0', 100, 'lane')} SELECT qid, id, score, rnk::INTEGER AS rnk FROM lane")
def lane_vector_topk(spark, d):
    return L.vector_lane(centroids(spark, d), vectors(spark, d).select("id", "v"), 100, 0.0)


_BITS = lambda v: f"list_transform(range(2), lambda j: list_sum(list_transform(range(32), lambda i: CASE WHEN {v}[32 * j + i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT)"


@query("lane_binary_rerank", f"""WITH {S.CENTROIDS}, qb AS (SELECT qid, qv, {_BITS('qv')} AS b FROM q), vb AS (SELECT id, v, {_BITS('v')} AS b FROM v),
h AS (SELECT qid, id, qv, v, bit_count(xor(qb.b[1], vb.b[1])) + bit_count(xor(qb.b[2], vb.b[2])) AS far FROM qb, vb),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY far, id) AS k FROM h) WHERE k <= 600),
scored AS (SELECT qid, id, round(list_inner_product(qv, v) / (sqrt(list_inner_product(qv, qv)) * sqrt(list_inner_product(v, v))), 6) AS score FROM near),
{S.ranked('scored', 'true', 30, 'lane')} SELECT qid, id, score, rnk::INTEGER AS rnk FROM lane""")
def lane_binary_rerank(spark, d):
    return L.binary_lane(centroids(spark, d), vectors(spark, d).select("id", "v"), 64, 30, 20)


@query("quantiser_agreement", f"""WITH {S.VECTOR_SCORED}, {S.ranked('scored', 'true', 30, 'exact')},
qb AS (SELECT qid, {_BITS('qv')} AS b FROM q), vb AS (SELECT id, {_BITS('v')} AS b FROM v),
near AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY bit_count(xor(qb.b[1], vb.b[1])) + bit_count(xor(qb.b[2], vb.b[2])), id) AS k FROM qb, vb) WHERE k <= 120)
SELECT exact.qid, round(count(near.id) / count(*), 6) AS agreement FROM exact LEFT JOIN near ON exact.qid = near.qid AND exact.id = near.id GROUP BY exact.qid""")
def quantiser_agreement(spark, d):
    q, v = centroids(spark, d), vectors(spark, d).select("id", "v")
    exact = L.vector_lane(q, v, 30).select("qid", "id")
    packed = L.pairwise(q.select("qid", V.sign_words(F.col("qv"), 64).alias("qb")), v.select("id", V.sign_words(F.col("v"), 64).alias("b")))
    near = L.top_k(packed.select("qid", "id", (-V.hamming(F.col("qb"), F.col("b"))).alias("score")), 120).select("qid", "id", F.lit(1).alias("in_near"))
    return exact.join(near, ["qid", "id"], "left").groupBy("qid").agg(F.round(F.count("in_near") / F.count(F.lit(1)), 6).alias("agreement"))


_TRI = f"""q AS (SELECT item_id AS qid, unnest(g) AS gram, len(g) AS n_q FROM (SELECT item_id, {S.text_trigrams('text')} AS g FROM benchmark)),
r AS (SELECT doc_id AS id, unnest(g) AS gram, len(g) AS n_row FROM (SELECT doc_id, {S.text_trigrams('substr(text, 1, 2000)')} AS g FROM documents)),
hits AS (SELECT qid, id, round(count(*) / n_q, 6) AS score FROM q JOIN r USING (gram) GROUP BY qid, id, n_q)"""


@query("lane_trigram_topk", f"WITH {_TRI}, {S.ranked('hits', 'score >= 0.4', 24, 'lane')} SELECT qid, id, score, rnk::INTEGER AS rnk FROM lane")
def lane_trigram_topk(spark, d):
    """The lane looks at 2,000 characters of a quote: a fixed value of the operator."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 2000).alias("text"))
    return L.trigram_lane(questions(spark, d), rows, 24, 0.4)


@query("word_similarity_bounds", f"""WITH c AS (SELECT a.conv_id, a.turn, {S.text_trigrams('a.text')} AS x, {S.text_trigrams('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
n AS (SELECT conv_id, turn, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS s FROM c)
SELECT conv_id, turn, round(s / greatest(1, nx + ny - s), 6) AS lower_bound, round(s / greatest(1, nx), 6) AS upper_bound FROM n""")
def word_similarity_bounds(spark, d):
    c = table(spark, d, "conversations")
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")), ["conv_id", "turn"])
    b = pairs.select("conv_id", "turn", L.similarity_bounds(F.col("text"), F.col("reply")).alias("b"))
    return b.select("conv_id", "turn", F.round("b.lower", 6).alias("lower_bound"), F.round("b.upper", 6).alias("upper_bound"))


_LANES = f"""WITH {S.HITS}, {S.ranked('hits', 'matched = n_terms', 24, 'and_lane')}, {S.ranked('hits', 'matched >= least(2, n_terms)', 24, 'or_lane')},
lanes AS (SELECT qid, 'and' AS lane, id, score, rnk, 1.0::DOUBLE AS weight FROM and_lane UNION ALL SELECT qid, 'or', id, score, rnk, 0.6::DOUBLE FROM or_lane)"""


def lanes(spark, d, dense: bool = False) -> DataFrame:
    return L.text_lanes(hits(spark, d, 24), 24, {"and": 1.0, "or": 0.6}, dense)


@query("rrf_fuse_ordinal", _LANES + """, f AS (SELECT qid, id, round(sum(weight / (60 + rnk)), 9) AS rrf, max(CASE WHEN lane = 'and' THEN rnk END) AS and_rank, max(CASE WHEN lane = 'or' THEN rnk END) AS or_rank FROM lanes GROUP BY qid, id)
SELECT qid, id, rrf, and_rank::INTEGER AS and_rank, or_rank::INTEGER AS or_rank, fused_rank::INTEGER AS fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS fused_rank FROM f) WHERE fused_rank <= 10""")
def rrf_fuse_ordinal(spark, d):
    """Flagship: every question's ten documents by fused rank."""
    fused = R.top_fused(R.fuse(lanes(spark, d)), R.SHOWN)
    return fused.select("qid", "id", "rrf", F.col("lane_ranks")["and"].alias("and_rank"), F.col("lane_ranks")["or"].alias("or_rank"), "fused_rank")


@query("rrf_fuse_dense", _LANES + """, dn AS (SELECT *, dense_rank() OVER (PARTITION BY qid, lane ORDER BY score DESC) AS dr FROM lanes)
SELECT qid, id, round(sum(weight / (60 + dr)), 9) AS rrf FROM dn GROUP BY qid, id""")
def rrf_fuse_dense(spark, d):
    return R.fuse(lanes(spark, d, dense=True)).select("qid", "id", "rrf")


@query("lane_row_counts", _LANES + " SELECT lane, count(*) AS n_rows, round(count(*) / count(DISTINCT qid), 6) AS mean_rows FROM lanes GROUP BY lane")
def lane_row_counts(spark, d):
    return lanes(spark, d).groupBy("lane").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.count(F.lit(1)) / F.count_distinct("qid"), 6).alias("mean_rows"))


_CAND = _LANES + """, f AS (SELECT qid, id, round(sum(weight / (60 + rnk)), 9) AS rrf, max(score) AS lexical, bool_or(lane = 'and') AS and_hit FROM lanes GROUP BY qid, id),
groups AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n, source FROM documents),
c AS (SELECT f.*, CASE WHEN n > 1 THEN first_id END AS dup_group, source, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, f.id) AS fused_rank FROM f JOIN groups USING (id)),
cand AS (SELECT * FROM c WHERE fused_rank <= 25)"""


def candidates(spark, d) -> DataFrame:
    """Fused candidates with what the reranker asks for; documents with one text form a duplicate group, told by digest and length."""
    key = [F.sha2("text", 256).alias("digest"), F.length("text").alias("size")]
    docs = table(spark, d, "documents")
    groups = docs.select("doc_id", *key).groupBy("digest", "size").agg(F.min("doc_id").alias("dup_group"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    top = R.top_fused(R.fuse(lanes(spark, d)), R.SHORTLIST).withColumn("and_hit", F.col("lane_ranks")["and"].isNotNull())
    return top.join(docs.select(F.col("doc_id").alias("id"), "source", *key), "id").join(groups, ["digest", "size"], "left")


@query("dup_penalty", _CAND + " SELECT qid, id, dup_group, (CASE WHEN dup_group IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY qid, dup_group ORDER BY fused_rank) - 1 END)::INTEGER AS dup_penalty FROM cand")
def dup_penalty(spark, d):
    earlier = F.row_number().over(Window.partitionBy("qid", "dup_group").orderBy("fused_rank")) - 1
    return candidates(spark, d).select("qid", "id", "dup_group", F.when(F.col("dup_group").isNull(), 0).otherwise(earlier).alias("dup_penalty"))


@query("owner_boost_priority", _CAND + """ SELECT qid, id, round(rrf * CASE WHEN source = 'src0' THEN 1.2 ELSE 1 END, 9) AS boosted,
row_number() OVER (PARTITION BY qid ORDER BY and_hit DESC, round(rrf * CASE WHEN source = 'src0' THEN 1.2 ELSE 1 END, 9) DESC, id)::INTEGER AS place FROM cand""")
def owner_boost_priority(spark, d):
    """The owner's voice counts 1.2 times; strong hits come first, then the boosted score."""
    c = candidates(spark, d).withColumn("boosted", F.round(F.col("rrf") * F.when(F.col("source") == "src0", R.OWNER_BOOST).otherwise(1.0), 9))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("and_hit"), F.desc("boosted"), "id"))
    return c.select("qid", "id", "boosted", place.alias("place"))


@query("rare_term_anchors", f"""WITH {S.query_terms(32)}, df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY term),
r AS (SELECT qid, term, df, row_number() OVER w AS k, sum(df) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM qt JOIN df USING (term) WINDOW w AS (PARTITION BY qid ORDER BY df, term)),
o AS (SELECT *, max(CASE WHEN k > 1 AND total > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY df, term ROWS UNBOUNDED PRECEDING) AS over_it FROM r)
SELECT qid, term, df, k::INTEGER AS k FROM o WHERE over_it = 0 AND k <= 3""")
def rare_term_anchors(spark, d):
    terms = P.query_terms(questions(spark, d))
    df = P.document_frequency(table(spark, d, "documents"), "text", terms.select("term").distinct())
    return L.scale_anchors(terms.join(df, "term"))


@query("scale_and_lane", f"WITH {S.HITS}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id) AS c FROM hits WHERE matched = n_terms) WHERE c <= 400), {S.ranked('c', 'true', 30, 'lane')} SELECT qid, id, score, rnk::INTEGER AS rnk FROM lane")
def scale_and_lane(spark, d):
    return L.top_k(L.capped(hits(spark, d).where("matched = n_terms").select("qid", "id", "score"), 400), 30)


@query("scale_or_lane_gated", f"""WITH {S.HITS}, thin AS (SELECT qid FROM (SELECT item_id AS qid FROM benchmark) b LEFT JOIN (SELECT qid, count(*) AS n FROM hits WHERE matched = n_terms GROUP BY qid) a USING (qid) WHERE coalesce(n, 0) < 10),
{S.ranked('hits', 'matched >= least(2, n_terms) AND qid IN (SELECT qid FROM thin)', 30, 'lane')} SELECT qid, id, score, rnk::INTEGER AS rnk FROM lane""")
def scale_or_lane_gated(spark, d):
    """The fragment lane of a question only runs if its exact lane has fewer than ten rows."""
    h = hits(spark, d, 30)
    full = h.where("matched = n_terms").groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    return L.or_lane(h.join(full, "qid", "left_anti"), 30)


@query("vector_gate", f"""WITH {S.HITS}, df AS (SELECT term, count(DISTINCT id) AS df FROM p GROUP BY term), rare AS (SELECT qid, min(df) AS rarest FROM qt JOIN df USING (term) GROUP BY qid),
a AS (SELECT DISTINCT qid FROM hits WHERE matched = n_terms)
SELECT item_id AS qid, coalesce(rarest <= 5, false) AND a.qid IS NOT NULL AS skip_vector FROM benchmark LEFT JOIN rare ON rare.qid = item_id LEFT JOIN a ON a.qid = item_id""")
def vector_gate(spark, d):
    reach = P.term_reach(table(spark, d, "documents"), "doc_id", "text", P.query_terms(questions(spark, d)))
    skip = F.coalesce(F.col("rarest") <= 5, F.lit(False)) & F.coalesce("full", F.lit(False))
    return questions(spark, d).join(reach, "qid", "left").select("qid", skip.alias("skip_vector"))


@query("spell_correction", f"""WITH words AS (SELECT DISTINCT word FROM (SELECT unnest({S.terms('text')}) AS word FROM conversations)), voc AS (SELECT DISTINCT term FROM (SELECT unnest({S.terms('text')}) AS term FROM benchmark)),
oov AS (SELECT word FROM words WHERE word NOT IN (SELECT term FROM voc)),
w AS (SELECT word, unnest(g) AS gram, len(g) AS nw FROM (SELECT word, {S.trigrams('word')} AS g FROM oov)), v AS (SELECT term, unnest(g) AS gram, len(g) AS nt FROM (SELECT term, {S.trigrams('term')} AS g FROM voc)),
s AS (SELECT word, term, round(count(*) / (nw + nt - count(*)), 6) AS similarity FROM w JOIN v USING (gram) GROUP BY word, term, nw, nt)
SELECT word, term, similarity FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, term) AS k FROM s WHERE similarity >= 0.3) WHERE k = 1""")
def spell_correction(spark, d):
    distinct = lambda t, name: table(spark, d, t).select(F.explode(T.terms(F.col("text"))).alias(name)).distinct()
    vocabulary = distinct("benchmark", "term")
    oov = distinct("conversations", "word").join(vocabulary, F.col("word") == F.col("term"), "left_anti")
    return L.nearest_terms(oov, vocabulary)


@query("vector_rank_of_target", f"""WITH {S.VECTOR_SCORED}, t AS (SELECT label AS qid, min(vec_id) AS target FROM embeddings GROUP BY label), own AS (SELECT t.qid, target, score AS own FROM t JOIN scored ON scored.qid = t.qid AND id = target)
SELECT qid, target, sum(CASE WHEN score > own THEN 1 ELSE 0 END)::BIGINT + 1 AS exact_rank FROM scored JOIN own USING (qid) GROUP BY qid, target""")
def vector_rank_of_target(spark, d):
    targets = vectors(spark, d).groupBy(F.col("label").alias("qid")).agg(F.min("id").alias("id"))
    return L.rank_of_target(centroids(spark, d), vectors(spark, d).select("id", "v"), targets)


@query("near_dup_groups", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS dup_group FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def near_dup_groups(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("size"))
    groups = rows.groupBy("digest", "size").agg(F.min("doc_id").alias("dup_group"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(groups, ["digest", "size"]).select("doc_id", "dup_group")


@query("archive_page_search", f"""WITH t AS (SELECT conv_id, turn, text, list_distinct({S.terms('text')}) AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, place::INTEGER AS place FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY list_contains(t, 'the') DESC, conv_id, turn) AS place FROM t WHERE list_contains(t, 'of')) WHERE place <= 51""")
def archive_page_search(spark, d):
    """Page of fifty and one more, which tells whether another page follows."""
    t = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.terms(F.col("text")).alias("t")).where(F.array_contains("t", "of"))
    page = t.orderBy(F.desc(F.array_contains("t", "the")), "conv_id", "turn").limit(51)
    order = Window.orderBy(F.desc(F.array_contains("t", "the")), "conv_id", "turn")
    return page.select("conv_id", "turn", F.row_number().over(order).alias("place"))


@query("lane_ivf_topk")
def lane_ivf_topk(spark, d):
    """Inverted lists around k-means centres: approximate, so it has no SQL. These vectors don't cluster, so 0.9 of the exact rows take 13 of 16 lists."""
    from corvane.operators.ivf import ivf_lane

    return ivf_lane(centroids(spark, d), vectors(spark, d).select("id", "v"), lists=16, probes=13, k=30)
