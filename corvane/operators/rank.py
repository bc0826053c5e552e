"""Fusion, admission, boosts, reranking, answer state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the two configurations.
RRF_K = 60
OWNER_BOOST, EDGE_SCALE, HOP_SCALE = 1.2, 0.5, 0.35
SIM_STRONG, SIM_FLOOR = 0.7, 0.5
SHORTLIST, SHOWN = 25, 10
RERANK_WEIGHTS = {"fused": 6.0, "lexical": 0.0, "cosine": 0.3, "entity": 0.0, "recency": 0.0, "dateFit": 0.5, "rareHit": 0.5, "dupPenalty": -0.5, "titleHit": 0.2}
RECENCY_HALF_LIFE_DAYS, DATE_FIT_HALF_LIFE_DAYS = 730.5, 365.25


def fuse(lanes: DataFrame, k: int = RRF_K) -> DataFrame:
    """lanes (qid, lane, id, score, rnk, weight) -> qid, id, rrf, lane_ranks, lexical (the best score of all lanes).

    A lane of weight 0 adds and admits nothing. Lanes may come without scores; lexical is null then.
    """
    heard = lanes.where("weight <> 0")
    heard = heard if "score" in heard.columns else heard.withColumn("score", F.lit(None).cast("double"))
    per_lane = heard.groupBy("qid", "id", "lane").agg(F.sum(F.col("weight") / (k + F.col("rnk"))).alias("part"), F.min("rnk").alias("rnk"), F.max("score").alias("score"))
    ranks = F.map_from_entries(F.sort_array(F.collect_list(F.struct("lane", "rnk")))).alias("lane_ranks")
    return per_lane.groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("rrf"), ranks, F.max("score").alias("lexical"))


def top_fused(fused: DataFrame, most: int = SHORTLIST) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("rrf"), F.asc("id"))
    return fused.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= most)


def admitted(or_hit: Column, trigram_hit: Column, via_edge: Column, and_hit: Column, cosine: Column) -> Column:
    """A vector hit below the strong mark is only kept if another lane has found the row too."""
    return or_hit | trigram_hit | via_edge | and_hit | (F.coalesce(cosine, F.lit(0.0)) >= SIM_STRONG)


def strong(and_hit: Column, cosine: Column) -> Column:
    return and_hit | (F.coalesce(cosine, F.lit(0.0)) >= SIM_STRONG)


def rerank(candidates: DataFrame, weights: dict[str, float] = RERANK_WEIGHTS) -> DataFrame:
    """candidates (qid, id, fused_rank, rrf, lexical, cosine, entity, recency, date_fit, rare_hit, title_hit, dup_group)
    -> with dup_penalty, score, final_rank. Fused and lexical scores count relative to the best of the question."""
    per_q = Window.partitionBy("qid")
    share = lambda c: F.when(F.max(c).over(per_q) > 0, F.col(c) / F.max(c).over(per_q)).otherwise(F.col(c))
    earlier = F.row_number().over(Window.partitionBy("qid", "dup_group").orderBy("fused_rank")) - 1
    out = candidates.withColumn("dup_penalty", F.when(F.col("dup_group").isNotNull(), earlier).otherwise(0))
    parts = {
        "fused": share("rrf"), "lexical": share("lexical"), "cosine": F.col("cosine"), "entity": F.col("entity"), "recency": F.col("recency"), "dateFit": F.col("date_fit"),
        "rareHit": F.col("rare_hit").cast("int"), "dupPenalty": F.col("dup_penalty"), "titleHit": F.col("title_hit").cast("int"),
    }
    score = sum((F.lit(w) * parts[name] for name, w in weights.items() if w), F.lit(0.0))
    out = out.withColumn("score", F.round(score, 9))
    return out.withColumn("final_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))))


def answer_state(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (qid, layer, strong, contradicted) -> qid, state, for every question, those without a hit included."""
    seen = hits.groupBy("qid").agg(
        F.bool_or((F.col("layer") == "node") & F.col("strong") & F.col("contradicted")).alias("conflict"),
        F.bool_or((F.col("layer") == "node") & F.col("strong")).alias("node"), F.bool_or((F.col("layer") == "evidence") & F.col("strong")).alias("evidence"),
    )
    state = F.when(F.col("node").isNull(), "missing").when(F.col("conflict"), "conflicting").when(F.col("node"), "supported").when(F.col("evidence"), "evidence").otherwise("partial")
    return questions.select("qid").join(seen, "qid", "left").select("qid", state.alias("state"))


def one_hop(hits: DataFrame, edges: DataFrame, scale: float = HOP_SCALE) -> DataFrame:
    """hits (qid, id, rrf), edges (source, target, why) -> neighbours that are no hits themselves: the best parent's share."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbour"), "why").unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("neighbour"), "why"))
    reached = hits.join(both, "id").select("qid", "neighbour", (F.col("rrf") * scale).alias("gain"), "why", "id")
    reached = reached.join(hits.select("qid", F.col("id").alias("neighbour")), ["qid", "neighbour"], "left_anti")
    best = F.max_by(F.struct("gain", "why", "id"), F.struct("gain", -F.col("id")))
    return reached.groupBy("qid", "neighbour").agg(best.alias("b")).select("qid", F.col("neighbour").alias("id"), F.round("b.gain", 9).alias("rrf"), F.col("b.id").alias("parent"), F.col("b.why").alias("why"))


def entity_match(wanted: DataFrame, tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """wanted (qid, slug), tags (id, slug), pairs (qid, id) -> pairs with entity: the share of a question's people and places that a row is tagged with."""
    wanted = wanted.select("qid", "slug").distinct()
    n = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    held = pairs.select("qid", "id").join(wanted, "qid").join(tags.select("id", "slug").distinct(), ["id", "slug"]).groupBy("qid", "id").agg(F.count(F.lit(1)).alias("held"))
    return pairs.join(n, "qid", "left").join(held, ["qid", "id"], "left").withColumn("entity", F.coalesce(F.col("held") / F.col("n"), F.lit(0.0))).drop("n", "held")


def envelope(questions: DataFrame, hits: DataFrame, states: DataFrame, degraded: DataFrame) -> DataFrame:
    """One row a question: state, a note, degraded, and its hits in order, each with where it is from and what to read next.

    questions (qid), hits (qid, final_rank, id, layer, score, lanes), states (qid, state), degraded (qid, lane) of lanes that failed.
    """
    read = F.concat(F.lit("read_"), F.col("layer"), F.lit(":"), F.col("id").cast("string"))
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("final_rank", "id", "layer", "score", "lanes", read.alias("next")))).alias("hits"))
    failed = degraded.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_set("lane")), ", ").alias("failed"))
    note = F.when(F.col("failed").isNotNull(), F.concat(F.lit("without "), F.col("failed"))).when(F.col("state") == "missing", "nothing was found")
    rows = questions.select("qid").join(states, "qid", "left").join(listed, "qid", "left").join(failed, "qid", "left")
    return rows.select("qid", "state", note.alias("note"), F.col("failed").isNotNull().alias("degraded"), F.coalesce("hits", F.array()).alias("hits"))


def attach_provenance(hits: DataFrame, messages: DataFrame | None) -> DataFrame:
    """hits (id, ...) with role, fidelity and revision of the archived message behind each; without that table, null and a note."""
    if messages is None:
        return hits.withColumns({**{c: F.lit(None).cast("string") for c in ("role", "fidelity", "revision")}, "note": F.lit("provenance is unavailable")})
    return hits.join(messages.select("id", "role", "fidelity", "revision"), "id", "left").withColumn("note", F.lit(None).cast("string"))


def attach_edges(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits (qid, id) with edges: those that begin or end at a hit (array of struct(edge, other, why) by edge)."""
    of = lambda here, there: edges.select(F.col(here).alias("id"), F.struct("edge", F.col(there).alias("other"), "why").alias("e"))
    both = of("source", "target").unionByName(of("target", "source"))
    listed = hits.select("id").distinct().join(both, "id").groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    return hits.join(listed, "id", "left").withColumn("edges", F.coalesce("edges", F.array()))
