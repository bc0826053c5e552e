"""Queries of the batched Python functions, of corpus generation and of vector geometry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import udfs as U
from corvane.functions import vectors as V
from corvane.operators import corpus as C
from corvane.operators import lanes as L
from corvane.plans import sqltext as S
from corvane.plans.registry import query
from corvane.plans.retrieval import centroids, lanes, questions, vectors
from corvane.sources import table

WORDS = ["amber", "birch", "cobalt", "delta", "ember", "fjord", "grove", "harbor", "island", "juniper", "kelp"]
N, SEED = 5000, "corpus-1"


def _draw(label: str, n: int) -> str:
    return f"('0x' || substr(md5('{SEED}/{label}/' || id), 1, 15))::BIGINT % {n}"


_WORD = lambda label: f"{WORDS!r}[{_draw(label, len(WORDS))} + 1]"


@query("seeded_corpus", f"""SELECT id, {C.FAMILIES!r}[{_draw('family', 7)} + 1] AS family, {_WORD('t1')} || ' ' || {_WORD('t2')} AS title, concat_ws(' ', {', '.join(_WORD(f'b{k}') for k in range(8))}) AS body,
 (DATE '2015-01-01' + ({_draw('day', 3652)})::INTEGER)::DATE::VARCHAR AS occurred_at, CASE WHEN {_draw('family', 7)} = 1 THEN substr(md5('{SEED}' || id), 1, 3) || '-' || ({_draw('rare', 9000)} + 1000) END AS rare_token FROM range({N}) r(id)""")
def seeded_corpus(spark, d):
    return C.generate(spark, N, SEED, WORDS)


@query("typo_corruption", f"""WITH w AS (SELECT DISTINCT term FROM (SELECT unnest({S.terms('text')}) AS term FROM benchmark) WHERE length(term) >= 4)
SELECT term, substr(term, 1, k - 1) || substr(term, k + 1, 1) || substr(term, k, 1) || substr(term, k + 2) AS typo FROM (SELECT term, (('0x' || substr(md5('typo/at/' || term), 1, 15))::BIGINT % (length(term) - 1) + 1)::INTEGER AS k FROM w)""")
def typo_corruption(spark, d):
    from corvane.functions import text as T

    w = table(spark, d, "benchmark").select(F.explode(T.terms(F.col("text"))).alias("term")).where(F.length("term") >= 4).distinct()
    place = (F.conv(F.substring(F.md5(F.concat(F.lit("typo/at/"), "term").cast("binary")), 1, 15), 16, 10).cast("long") % (F.length("term") - 1) + 1).cast("int")
    return w.withColumn("k", place).select("term", C.with_typo(F.col("term"), F.col("k")).alias("typo"))


@query("geometry_statistics", f"""WITH {S.VECTOR_SCORED}, k AS (SELECT scored.*, label = qid AS same, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rnk FROM scored JOIN v USING (id))
SELECT qid, max(CASE WHEN rnk = 2 THEN score END) AS at_2, max(CASE WHEN rnk = 10 THEN score END) AS at_10, max(CASE WHEN rnk = 30 THEN score END) AS at_30, round(avg(CASE WHEN rnk <= 30 THEN same::INTEGER END), 6) AS same_share, round(avg(CASE WHEN same THEN score END), 5) AS sibling_mean FROM k GROUP BY qid""")
def geometry_statistics(spark, d):
    v = vectors(spark, d)
    scored = L.pairwise(centroids(spark, d), v).select("qid", "id", (F.col("label") == F.col("qid")).alias("same"), F.round(V.cosine(F.col("qv"), F.col("v")), 6).alias("score"))
    k = scored.withColumn("rnk", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    at = [F.max(F.when(F.col("rnk") == r, F.col("score"))).alias(f"at_{r}") for r in (2, 10, 30)]
    return k.groupBy("qid").agg(*at, F.round(F.avg(F.when(F.col("rnk") <= 30, F.col("same").cast("int"))), 6).alias("same_share"), F.round(F.avg(F.when(F.col("same"), F.col("score"))), 5).alias("sibling_mean"))


@query("word_similarity_extents")
def word_similarity_extents(spark, d):
    """How well each page's title is found again in its first 4,000 characters, the operator's fixed reach for pages."""
    body = F.substring(F.regexp_replace("html", r"(?s)^.*?</head>|<[^>]*>", " "), 1, 4000)
    return table(spark, d, "pages").select("page_id", F.round(U.word_similarity(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), body), 6).alias("similarity"))


@query("excerpt_selection")
def excerpt_selection(spark, d):
    """The 700 characters of each candidate that answer its question best."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = lanes(spark, d).select("qid", "id").distinct().join(docs, "id").join(questions(spark, d).withColumnRenamed("text", "question"), "qid")
    return found.select("qid", "id", U.excerpt(F.col("text"), F.col("question")).alias("e")).select("qid", "id", "e.start", "e.excerpt")


@query("canonical_json_digest", """SELECT event_id, sha256('{"a":{"k":' || json_extract_string(props, '$.k') || '},"b":"' || event_type || '"}') AS digest FROM events""")
def canonical_json_digest(spark, d):
    raw = F.concat(F.lit('{"b": "'), "event_type", F.lit('", "a": '), "props", F.lit("}"))
    return table(spark, d, "events").select("event_id", F.sha2(U.canonical_json(raw), 256).alias("digest"))


@query("deadline_inference", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2024-02-01 23:59:59' + to_days((event_id % 20)::INTEGER) WHEN event_id % 4 = 1 THEN TIMESTAMP '2024-03-05 23:59:59' END AS due_at FROM events""")
def deadline_inference(spark, d):
    """Notes made of events, one form in four each: "due in n days", "by March 5, 2024", no cue, a date that is past."""
    n = (F.col("event_id") % 20).cast("string")
    forms = [F.concat(F.lit("report is due in "), n, F.lit(" days")), F.lit("send it by March 5, 2024"), F.lit("met on March 5, 2024"), F.lit("valid until 2023-05-01")]
    note = F.element_at(F.array(*forms), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", U.deadline(note, datetime(2024, 2, 1)).cast("timestamp_ntz").alias("due_at"))


@query("utf16_offsets", "SELECT doc_id, length(text) AS points, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) AS units FROM documents")
def utf16_offsets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("points"), (F.length(F.encode("text", "UTF-16BE")) / 2).cast("long").alias("units"))


@query("sampled_scan")
def sampled_scan(spark, d):
    """An estimate of counts from a tenth of the rows, scaled up: sampling is the operator."""
    return table(spark, d, "events").sample(0.1, seed=7).groupBy("event_type").agg((F.count(F.lit(1)) * 10).alias("estimated"))


@query("rerank_weight_fit")
def rerank_weight_fit(spark, d):
    """Lane weights fitted by coordinate descent on the fused candidates of questions with a known target."""
    import numpy as np

    from corvane.operators import rank as R
    from corvane.plans.evaluation import targets

    fused = R.top_fused(R.fuse(lanes(spark, d))).join(targets(spark, d).withColumn("hit", F.lit(True)), ["qid", "id"], "left")
    part = lambda lane: F.coalesce(1 / (60 + F.col("lane_ranks")[lane]), F.lit(0.0))
    rows = fused.orderBy("qid", "fused_rank").select("qid", part("and").alias("a"), part("or").alias("o"), F.coalesce("hit", F.lit(False)).alias("hit")).toPandas()
    w, recall = C.descend(rows[["a", "o"]].to_numpy(), rows["qid"].to_numpy(), rows["hit"].to_numpy(), np.array([1.0, 0.6]), np.linspace(0, 3, 16))
    return spark.createDataFrame([("and", float(w[0]), recall), ("or", float(w[1]), recall)], "lane string, weight double, recall_at_10 double")
