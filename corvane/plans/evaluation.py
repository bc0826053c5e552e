"""Queries of evaluation, operation traces, pagination, scans and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import lanes as L
from corvane.operators import metrics as M
from corvane.operators.corpus import FAMILIES
from corvane.plans import sqltext as S
from corvane.plans.registry import query
from corvane.plans.retrieval import _LANES, centroids, hits, vectors
from corvane.sources import table

#: Resamples of an interval.
RESAMPLES = 10_000


def targets(spark, d) -> DataFrame:
    """qid, id: the documents that hold a question's text word for word."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("page"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return L.holders(asked, docs)


_TARGETS = "tg AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_RANKS = f"WITH {S.HITS}, {S.ranked('hits', 'matched >= least(2, n_terms)', 24, 'lane')}, {_TARGETS}, r AS (SELECT tg.qid, min(rnk) AS rank, count(*) AS n_targets, count(rnk) AS n_found FROM tg LEFT JOIN lane ON tg.qid = lane.qid AND tg.id = lane.id GROUP BY tg.qid)"


def ranks(spark, d) -> DataFrame:
    return M.best_ranks(L.or_lane(hits(spark, d, 24), 24), targets(spark, d))


@query("recall_at_k", _RANKS + " SELECT count(*) AS n, round(avg((coalesce(rank, 999) <= 1)::INT), 6) AS recall_at_1, round(avg((coalesce(rank, 999) <= 5)::INT), 6) AS recall_at_5, round(avg((coalesce(rank, 999) <= 10)::INT), 6) AS recall_at_10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_at_10 FROM r")
def recall_at_k(spark, d):
    return M.summary(ranks(spark, d))


@query("macro_recall", _RANKS + " SELECT qid, n_targets, n_found, round(n_found / n_targets, 6) AS share FROM r")
def macro_recall(spark, d):
    return ranks(spark, d).select("qid", "n_targets", "n_found", F.round(F.col("n_found") / F.col("n_targets"), 6).alias("share"))


_DRAWN = lambda seed: f"""c AS (SELECT count(*) AS n, avg(x) AS p FROM v), dr AS (SELECT r, ('0x' || substr(md5('{seed}:' || r || ':' || place), 1, 15))::BIGINT % n AS place FROM v, c, range({RESAMPLES}) t(r)),
m AS (SELECT r, round(avg(x), 9) AS m FROM dr JOIN v USING (place) GROUP BY r), k AS (SELECT m, row_number() OVER (ORDER BY m, r) - 1 AS k FROM m)
SELECT round((SELECT p FROM c), 6) AS point, round(max(CASE WHEN k = {int(0.025 * RESAMPLES)} THEN m END), 6) AS lower, round(max(CASE WHEN k = {-(-39 * RESAMPLES // 40) - 1} THEN m END), 6) AS upper FROM k"""  # noqa: E731


def interval(values: DataFrame, seed: str) -> DataFrame:
    """values (qid, x): one a question, numbered in the order of the questions."""
    numbered = values.select((F.row_number().over(Window.orderBy("qid")) - 1).cast("long").alias("place"), F.col("x").cast("double").alias("x"))
    drawn = lambda r, i, n: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), r, F.lit(":"), i).cast("binary")), 1, 15), 16, 10).cast("long") % n
    return M.bootstrap(numbered, RESAMPLES, drawn)


@query("bootstrap_ci", _RANKS + ", v AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS place, CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END AS x FROM r), " + _DRAWN("boot"))
def bootstrap_ci(spark, d):
    """Recall at 10 of the fragment lane with its interval."""
    return interval(ranks(spark, d).select("qid", F.when(F.col("rank") <= 10, 1.0).otherwise(0.0).alias("x")), "boot")


@query("paired_delta_ci", f"""WITH {S.HITS}, {S.ranked('hits', 'matched >= least(2, n_terms)', 24, 'lane')}, {S.ranked('hits', 'matched = n_terms', 24, 'full')}, {_TARGETS}, h AS (SELECT tg.qid, coalesce(min(lane.rnk) <= 3, false)::INTEGER AS a, coalesce(min(f.rnk) <= 3, false)::INTEGER AS b FROM tg LEFT JOIN lane ON tg.qid = lane.qid AND tg.id = lane.id LEFT JOIN "full" f ON tg.qid = f.qid AND tg.id = f.id GROUP BY tg.qid),
v AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS place, (a - b)::DOUBLE AS x FROM h), """.replace("full AS", '"full" AS') + _DRAWN("paired"))
def paired_delta_ci(spark, d):
    """By how much the fragment lane finds a target among its first three more often than the exact lane, question by question."""
    h, tg = hits(spark, d, 24), targets(spark, d)
    one = lambda lane, name: M.best_ranks(lane, tg).select("qid", F.when(F.col("rank") <= 3, 1).otherwise(0).alias(name))
    both = one(L.or_lane(h, 24), "a").join(one(L.and_lane(h, 24), "b"), "qid")
    return interval(both.select("qid", (F.col("a") - F.col("b")).alias("x")), "paired")


def family(qid) -> Column:
    return F.element_at(F.array(*map(F.lit, FAMILIES)), (qid % len(FAMILIES) + 1).cast("int"))


_FAMILY = f"{FAMILIES!r}[qid % {len(FAMILIES)} + 1] AS family"
_BY_FAMILY = _RANKS + f", f AS (SELECT {_FAMILY}, count(*) AS n, avg((coalesce(rank, 999) <= 10)::INT) AS recall FROM r GROUP BY 1)"


def by_family(spark, d) -> DataFrame:
    return ranks(spark, d).groupBy(family(F.col("qid")).alias("family")).agg(F.count(F.lit(1)).alias("n"), M.recall_at(F.col("rank"), 10).alias("recall"))


@query("per_family_metrics", _BY_FAMILY + " SELECT family, n, round(recall, 6) AS recall_at_10 FROM f")
def per_family_metrics(spark, d):
    return by_family(spark, d).select("family", "n", F.round("recall", 6).alias("recall_at_10"))


_MIX = {"paraphrase_nolex": 0.3, "rare_token": 0.1, "typo_noisy": 0.2}


@query("mix_weighted_recall", _BY_FAMILY + f", w AS (SELECT *, coalesce(CASE family {' '.join(f'WHEN {k!r} THEN {v}::DOUBLE' for k, v in _MIX.items())} END, n / sum(n) OVER ()) AS w FROM f) SELECT round(sum(w * recall) / sum(w), 6) AS weighted, round(avg(recall), 6) AS unweighted, count(*) AS families FROM w")
def mix_weighted_recall(spark, d):
    """Recall by the shares of the families that are asked for, and by counts where there is no share."""
    return M.mix_weighted(by_family(spark, d), spark.createDataFrame(list(_MIX.items()), "family string, share double"))


@query("survivor_depth", _LANES + """, f AS (SELECT qid, id, round(sum(weight / (60 + rnk)), 9) AS rrf, max(score) AS lexical FROM lanes GROUP BY qid, id), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS fr FROM f),
s AS (SELECT *, round(rrf / max(rrf) OVER (PARTITION BY qid) + 2 * lexical / max(lexical) OVER (PARTITION BY qid), 9) AS score FROM k WHERE fr <= 40),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS last FROM s)
SELECT count(*) AS survivors, max(fr)::INTEGER AS deepest, count_if(fr > 25)::BIGINT AS past_25 FROM y WHERE last <= 10""")
def survivor_depth(spark, d):
    """How far down in the fused order the ten rows that are shown after reranking come from."""
    from corvane.operators import rank as R
    from corvane.plans.retrieval import lanes

    top = R.top_fused(R.fuse(lanes(spark, d)), 40)
    zero = {c: F.lit(0.0) for c in ("cosine", "entity", "recency", "date_fit")} | {c: F.lit(False) for c in ("rare_hit", "title_hit")} | {"dup_group": F.lit(None).cast("long")}
    shown = R.rerank(top.withColumns(zero), {"fused": 1.0, "lexical": 2.0}).where("final_rank <= 10")
    return shown.agg(F.count(F.lit(1)).alias("survivors"), F.max("fused_rank").alias("deepest"), F.count_if(F.col("fused_rank") > 25).alias("past_25"))


@query("oracle_by_family", f"""WITH {S.HITS}, {S.ranked('hits', 'matched >= least(2, n_terms)', 100, 'o')}, {S.ranked('hits', 'matched = n_terms', 100, 'a')}, {_TARGETS}, x AS (SELECT tg.qid, {_FAMILY.replace('qid', 'tg.qid')}, min(a.rnk) AS a, min(o.rnk) AS o FROM tg LEFT JOIN a ON tg.qid = a.qid AND tg.id = a.id LEFT JOIN o ON tg.qid = o.qid AND tg.id = o.id GROUP BY tg.qid)
SELECT family, count(*) AS n, count_if(least(a, o) <= 10)::BIGINT AS best_lane_hits, count_if(least(a, o) <= 100)::BIGINT AS depth_hits, count_if(a <= 10)::BIGINT AS by_and_rank, count_if(o <= 10)::BIGINT AS by_or_rank FROM x GROUP BY family""")
def oracle_by_family(spark, d):
    """What the best lane alone would find, how deep the lanes would have to be read, and which lane solves how much."""
    h, tg = hits(spark, d, 100), targets(spark, d)
    one = lambda lane, name: M.best_ranks(lane, tg).select("qid", F.col("rank").alias(name))
    r = one(L.and_lane(h, 100), "and_rank").join(one(L.or_lane(h, 100), "or_rank"), "qid").withColumn("family", family(F.col("qid")))
    return M.oracle_by_family(r, ["and_rank", "or_rank"], 10, 100)


_CEILINGS = f"""WITH {S.HITS}, {_TARGETS}, own AS (SELECT tg.qid, tg.id, h.matched, h.n_terms FROM tg LEFT JOIN hits h ON h.qid = tg.qid AND h.id = tg.id AND h.matched >= least(2, h.n_terms)),
ce AS (SELECT qid, id, matched, n_terms, CASE WHEN matched = n_terms THEN (SELECT count(*) FROM hits x WHERE x.qid = own.qid AND x.matched = x.n_terms) END AS and_ceiling, CASE WHEN matched IS NOT NULL THEN (SELECT count(*) FROM hits x WHERE x.qid = own.qid AND x.matched >= own.matched) END AS or_ceiling FROM own)"""


@query("lane_ceilings", _CEILINGS + " SELECT qid, id, and_ceiling, or_ceiling FROM ce")
def lane_ceilings(spark, d):
    return M.lane_ceilings(hits(spark, d), targets(spark, d))


@query("certificates", _CEILINGS + ", c AS (SELECT *, list_filter([CASE WHEN and_ceiling <= 24 THEN 'and' END, CASE WHEN or_ceiling <= 24 THEN 'or' END], lambda s: s IS NOT NULL) AS s FROM ce) SELECT qid, id, array_to_string(s, ',') AS signals, len(s) > 0 AS solvable, round(coalesce(matched / n_terms, 0), 6) AS overlap FROM c")
def certificates(spark, d):
    """Which questions can be answered at all: the lanes whose ceilings lie within their depth, and how many terms are shared."""
    h, tg = hits(spark, d), targets(spark, d)
    overlap = h.join(tg, ["qid", "id"]).select("qid", "id", (F.col("matched") / F.col("n_terms")).alias("overlap"))
    return M.certificate(M.lane_ceilings(h, tg), overlap, 24).select("qid", "id", "signals", "solvable", F.round(F.coalesce("overlap", F.lit(0.0)), 6).alias("overlap"))


@query("oracle_summary", f"""WITH {S.VECTOR_SCORED}, k AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rnk FROM scored)
SELECT k.qid, min(rnk)::INTEGER AS best_rank, count_if(rnk <= 10)::BIGINT AS within_10, count_if(rnk <= 100)::BIGINT AS within_100, round(avg(rnk), 6) AS mean_rank FROM k JOIN v ON v.id = k.id AND v.label = k.qid GROUP BY k.qid""")
def oracle_summary(spark, d):
    """How far down the vector lane a question's own rows lie."""
    v = vectors(spark, d)
    n = v.count()
    ranked = L.vector_lane(centroids(spark, d), v.select("id", "v"), n).join(v.select("id", "label"), "id").where("label = qid")
    return ranked.groupBy("qid").agg(F.min("rnk").alias("best_rank"), F.count_if(F.col("rnk") <= 10).alias("within_10"), F.count_if(F.col("rnk") <= 100).alias("within_100"), F.round(F.avg("rnk"), 6).alias("mean_rank"))


@query("trace_summary_percentiles", """SELECT event_type AS operation, count(*) AS operations, count_if(value > 300)::BIGINT AS errors, count_if(value < 1)::BIGINT AS empty_retrievals,
 quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type
 UNION ALL SELECT '(all)', count(*), count_if(value > 300)::BIGINT, count_if(value < 1)::BIGINT, quantile_disc(value, 0.5), quantile_disc(value, 0.95), quantile_disc(value, 0.99) FROM events""")
def trace_summary_percentiles(spark, d):
    e = table(spark, d, "events")
    aggs = [F.count(F.lit(1)).alias("operations"), F.count_if(F.col("value") > 300).alias("errors"), F.count_if(F.col("value") < 1).alias("empty_retrievals"), *[M.nearest_rank("value", p / 100).alias(f"p{p}") for p in (50, 95, 99)]]
    return e.groupBy(F.col("event_type").alias("operation")).agg(*aggs).unionByName(e.agg(*aggs).select(F.lit("(all)").alias("operation"), "*"))


@query("latency_percentiles_interpolated", """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY event_type""")
def latency_percentiles_interpolated(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))], F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"))


@query("floor_index_percentile", "SELECT event_type, list_sort(list(value))[least(count(*) - 1, floor(0.9 * count(*)))::BIGINT + 1] AS p90 FROM events GROUP BY event_type")
def floor_index_percentile(spark, d):
    """The value at place floor(p n), by rank and count: no group is gathered in a list."""
    w = Window.partitionBy("event_type")
    e = table(spark, d, "events").withColumn("k", F.row_number().over(w.orderBy("value")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return e.where(F.col("k") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9))).select("event_type", F.col("value").alias("p90"))


@query("label_frequencies", "SELECT event_type, count_if(value < 10)::BIGINT AS low, count_if(value >= 10 AND value < 100)::BIGINT AS middle, count_if(value >= 100)::BIGINT AS high FROM events GROUP BY event_type")
def label_frequencies(spark, d):
    band = F.when(F.col("value") < 10, "low").when(F.col("value") < 100, "middle").otherwise("high")
    counts = table(spark, d, "events").withColumn("band", band).groupBy("event_type").pivot("band", ["low", "middle", "high"])
    return counts.count().na.fill(0)


@query("index_status_counts", "SELECT 'evidence' AS layer, count(*) AS total, count(lang) AS indexed, count_if(lang IS NULL)::BIGINT AS waiting FROM documents UNION ALL SELECT 'nodes', count(*), count(html), count_if(html IS NULL)::BIGINT FROM pages UNION ALL SELECT 'vectors', count(*), count(embedding), count_if(embedding IS NULL)::BIGINT FROM embeddings")
def index_status_counts(spark, d):
    one = lambda layer, t, c: table(spark, d, t).agg(F.count(F.lit(1)).alias("total"), F.count(c).alias("indexed"), F.count_if(F.col(c).isNull()).alias("waiting")).select(F.lit(layer).alias("layer"), "*")
    return one("evidence", "documents", "lang").unionByName(one("nodes", "pages", "html")).unionByName(one("vectors", "embeddings", "embedding"))


@query("evidence_count_per_episode", "SELECT c_custkey AS episode, count(o_orderkey) AS evidence_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def evidence_count_per_episode(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("episode"), F.coalesce("n", F.lit(0)).alias("evidence_count"))


_SHARES = "WITH s AS (SELECT source AS name, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY source)"


@query("largest_remainder_counts", _SHARES + """, r AS (SELECT name, share * 997 AS raw, floor(share * 997)::BIGINT AS base FROM s), k AS (SELECT *, row_number() OVER (ORDER BY round(raw - base, 9) DESC, name) AS k, 997 - (SELECT sum(base) FROM r) AS left_over FROM r)
SELECT name, base + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS n FROM k""")
def largest_remainder_counts(spark, d):
    docs = table(spark, d, "documents")
    total = docs.count()
    shares = docs.groupBy(F.col("source").alias("name")).agg((F.count(F.lit(1)) / F.lit(total)).alias("share"))
    return M.apportion(shares, 997)


@query("keyset_page", "SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_id > 100) WHERE k <= 51 AND event_type <> 'view'")
def keyset_page(spark, d):
    """Fifty inspected rows after the cursor and one more; the filter comes after, so the cursor moves over what it drops."""
    page = table(spark, d, "events").where("event_id > 100").orderBy("event_id").limit(51)
    return page.where("event_type <> 'view'").select("event_id", "event_type", "value")


@query("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 21 OFFSET 40")
def offset_page(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(21)


@query("nulls_last_queue", "SELECT node_id, place::INTEGER AS place FROM (SELECT c_custkey AS node_id, row_number() OVER (ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END ASC NULLS LAST, c_custkey) AS place FROM customer) WHERE place <= 64")
def nulls_last_queue(spark, d):
    key = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    head = table(spark, d, "customer").withColumn("key", key).orderBy(F.asc_nulls_last("key"), "c_custkey").limit(64)
    return head.select(F.col("c_custkey").alias("node_id"), F.row_number().over(Window.orderBy(F.asc_nulls_last("key"), "c_custkey")).alias("place"))


@query("tuple_comparison", "SELECT count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND (a.turn, a.role) < (b.turn, b.role)")
def tuple_comparison(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role").alias("at"))
    return c.join(c.select("conv_id", F.col("at").alias("other")), "conv_id").where(F.col("at") < F.col("other")).agg(F.count(F.lit(1)).alias("n"))


@query("context_neighbours", """WITH a AS (SELECT conv_id, max(turn) // 2 AS anchor FROM conversations GROUP BY conv_id),
n AS (SELECT c.conv_id, c.turn, anchor, row_number() OVER (PARTITION BY c.conv_id, c.turn < anchor ORDER BY abs(c.turn - anchor), c.turn) AS k FROM conversations c JOIN a USING (conv_id) WHERE c.turn <> anchor)
SELECT conv_id, anchor, turn, CASE WHEN turn < anchor THEN 'before' ELSE 'after' END AS side FROM n WHERE k <= 2""")
def context_neighbours(spark, d):
    """Two turns on either side of each conversation's middle."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    anchors = c.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("anchor"))
    near = c.join(anchors, "conv_id").where("turn <> anchor").withColumn("side", F.when(F.col("turn") < F.col("anchor"), "before").otherwise("after"))
    k = F.row_number().over(Window.partitionBy("conv_id", "side").orderBy(F.abs(F.col("turn") - F.col("anchor")), "turn"))
    return near.withColumn("k", k).where("k <= 2").select("conv_id", "anchor", "turn", "side")


@query("later_revisions", "SELECT conv_id, turn, EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1) AS has_later FROM conversations c")
def later_revisions(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("has_later")).distinct()
    return c.join(later, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("has_later", F.lit(False)).alias("has_later"))


@query("index_listing", "SELECT o_orderkey, c_name AS source_title, s.n_name AS source_nation, t.n_name AS target_nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation s ON s.n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN supplier ON s_suppkey = l_suppkey JOIN nation t ON t.n_nationkey = s_nationkey")
def index_listing(spark, d):
    """Edges with the titles of both ends: a dimension joined twice under two names."""
    nation = table(spark, d, "nation")
    end = lambda name: nation.select(F.col("n_nationkey").alias(f"{name}_key"), F.col("n_name").alias(f"{name}_nation"))
    e = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(end("source"), F.col("c_nationkey") == F.col("source_key"))
    e = e.join(table(spark, d, "lineitem").where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return e.join(end("target"), F.col("s_nationkey") == F.col("target_key")).select("o_orderkey", F.col("c_name").alias("source_title"), "source_nation", "target_nation")


@query("lane_rank_objects", _LANES + " SELECT qid, id, string_agg(lane || '=' || rnk, ',' ORDER BY lane) AS lane_ranks FROM lanes GROUP BY qid, id")
def lane_rank_objects(spark, d):
    from corvane.operators import rank as R
    from corvane.plans.retrieval import lanes

    entries = F.transform(F.map_entries("lane_ranks"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return R.fuse(lanes(spark, d)).select("qid", "id", F.array_join(F.array_sort(entries), ",").alias("lane_ranks"))
