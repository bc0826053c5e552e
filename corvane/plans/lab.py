"""Queries of corpus builders, shapes, geometry, index sweeps and superseded claims."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators import corpus as C
from corvane.operators import lanes as L
from corvane.plans.extras import N, SEED, WORDS, _draw
from corvane.plans.registry import query
from corvane.plans.retrieval import centroids, vectors
from corvane.sources import table

_W = lambda label: f"{WORDS!r}[{_draw(label, len(WORDS))} + 1]"


@query("family_questions", f"""WITH g AS (SELECT id, {C.FAMILIES!r}[{_draw('family', 7)} + 1] AS family, {_W('t1')} AS a, {_W('t2')} AS b, {_W('b0')} AS c, DATE '2015-01-01' + ({_draw('day', 3652)})::INTEGER AS d, substr(md5('{SEED}' || id), 1, 3) || '-' || ({_draw('rare', 9000)} + 1000) AS tok FROM range({N}) r(id))
SELECT id, family, CASE family WHEN 'rare_token' THEN 'what was ' || tok WHEN 'entity_swap' THEN b || ' ' || a WHEN 'near_dup' THEN a || ' ' || b || ' ' || c WHEN 'date_filter' THEN a || ' in ' || year(d) WHEN 'partial_ref' THEN 'the ' || a WHEN 'typo_noisy' THEN substr(a, 2, 1) || substr(a, 1, 1) || substr(a, 3) || ' ' || b ELSE 'something like ' || c END AS question FROM g""")
def family_questions(spark, d):
    """A question for every memory of the seeded corpus, by the builder of its family."""
    return C.questions_of(C.generate(spark, N, SEED, WORDS), SEED).select("id", "family", "question")


@query("shuffled_ids", f"SELECT id, row_number() OVER (ORDER BY md5('{SEED}/shuffle/' || id), id) - 1 AS place FROM range({N}) r(id)")
def shuffled_ids(spark, d):
    """A seeded order of a whole corpus: ids by a digest, so that any engine shuffles alike."""
    return C.shuffled(spark.range(N), SEED)


@query("repaired_targets", f"""WITH g AS (SELECT id, {C.FAMILIES!r}[{_draw('family', 7)} + 1] AS family FROM range({N}) r(id)), t AS (SELECT r, id, ('0x' || substr(md5('{SEED}/retarget/' || r || '/' || id), 1, 15))::BIGINT % {N} AS target FROM g, range(4) k(r)),
ok AS (SELECT t.id, r, target, row_number() OVER (PARTITION BY t.id ORDER BY r) AS k FROM t JOIN g ON g.id = t.target JOIN g o ON o.id = t.id WHERE g.family = o.family AND t.target <> t.id) SELECT g.id, target, CASE WHEN target IS NULL THEN 4 ELSE r + 1 END::INTEGER AS rounds FROM g LEFT JOIN ok ON ok.id = g.id AND k = 1""")
def repaired_targets(spark, d):
    """Questions that can't be answered get another target, drawn again for four rounds at most until one fits their family."""
    g = C.generate(spark, N, SEED, WORDS).select("id", "family")
    return C.retarget(g, N, SEED, 4)


@query("corpus_shapes", """SELECT 'documents' AS name, count(*) AS rows, count_if(text IS NULL OR trim(text) = '')::BIGINT AS blank, count(*) - count(DISTINCT doc_id) AS repeated, count_if(n_chars <> length(text))::BIGINT AS mismatched FROM documents""")
def corpus_shapes(spark, d):
    """What must hold for every row of a corpus before it is loaded, and how often it doesn't."""
    docs = table(spark, d, "documents")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    found = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"), F.count_if(F.col("n_chars") != F.length("text")).alias("mismatched"))
    return found.join(repeated).select(F.lit("documents").alias("name"), "rows", "blank", "repeated", "mismatched")  # two tables of one row


@query("sibling_cosines", """WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)
SELECT a.label, count(*) AS pairs, round(avg(list_inner_product(a.u, b.u)), 6) AS mean_cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def sibling_cosines(spark, d):
    """The mean cosine of all pairs of a label, without the pairs: the length of the sum of unit vectors tells it."""
    u = table(spark, d, "embeddings").select("label", V.unit(V.as_double(F.col("embedding"))).alias("u"))
    sums = u.groupBy("label").agg(F.array(*[F.sum(F.col("u")[i]) for i in range(64)]).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = F.col("n") * (F.col("n") - 1)
    return sums.select("label", (pairs / 2).cast("long").alias("pairs"), F.round((V.dot(F.col("s"), F.col("s")) - F.col("n")) / pairs, 6).alias("mean_cosine"))


@query("index_sweep")
def index_sweep(spark, d):
    """How much of the exact lane's first and first thirty rows the inverted lists find, by lists probed; all of them find everything."""
    from corvane.operators.ivf import ivf_lane

    q, v = centroids(spark, d), vectors(spark, d).select("id", "v")
    exact = L.vector_lane(q, v, 30).select("qid", "id", "rnk")
    out = None
    for probes in (1, 4, 8, 16):
        found = ivf_lane(q, v, lists=16, probes=probes, k=30).select("qid", "id", F.lit(1).alias("found"))
        hit = exact.join(found, ["qid", "id"], "left")
        one = hit.agg(F.round(F.avg(F.when(F.col("rnk") == 1, F.coalesce("found", F.lit(0)))), 6).alias("hit_at_1"), F.round(F.avg(F.coalesce("found", F.lit(0))), 6).alias("hit_at_30")).select(F.lit(probes).alias("probes"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_CHAIN = "c AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


@query("superseded_claims", f"WITH {_CHAIN} SELECT a.id, b.id AS superseded_by, a.k = a.n AS is_current FROM c a LEFT JOIN c b ON a.subject = b.subject AND b.k = a.k + 1")
def superseded_claims(spark, d):
    """Each claim with the one that supersedes it; what nothing supersedes is current."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("superseded_by"))
    return rows.withColumn("is_current", F.col("superseded_by").isNull())


@query("inverse_relations", "SELECT 'customer:' || c_custkey AS source, 'lives_in' AS predicate, 'nation:' || c_nationkey AS target FROM customer UNION ALL SELECT 'nation:' || c_nationkey, 'home_of', 'customer:' || c_custkey FROM customer")
def inverse_relations(spark, d):
    """Relations in both directions, where a predicate has a name for the other one."""
    from corvane.operators.temporal import with_inverses

    own = table(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("source"), F.lit("lives_in").alias("predicate"), F.concat(F.lit("nation:"), "c_nationkey").alias("target"))
    return with_inverses(own, spark.createDataFrame([("lives_in", "home_of"), ("part_of", "holds")], "predicate string, inverse string"))
