"""Evaluation: recall, reciprocal rank, bootstrap intervals, percentiles, failure causes, apportionment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_ranks(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """hits (qid, id, rnk), targets (qid, id) -> qid, rank of its best target (null if absent), for every qid with a target."""
    return targets.join(hits, ["qid", "id"], "left").groupBy("qid").agg(F.min("rnk").alias("rank"), F.count(F.lit(1)).alias("n_targets"), F.count("rnk").alias("n_found"))


def recall_at(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def mrr_at(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, 1.0 / rank).otherwise(0.0))


def summary(ranks: DataFrame) -> DataFrame:
    r = F.col("rank")
    return ranks.agg(
        F.count(F.lit(1)).alias("n"), *[F.round(recall_at(r, k), 6).alias(f"recall_at_{k}") for k in (1, 5, 10)], F.round(mrr_at(r, 10), 6).alias("mrr_at_10"),
    )


def nearest_rank(column: str, p: float) -> Column:
    """sorted[ceil(n p) - 1]"""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")


def bootstrap(values: DataFrame, resamples: int, draw: Callable[[Column, Column, int], Column], level: float = 0.95) -> DataFrame:
    """values (place from 0, x) -> point, lower, upper: percentile interval of the mean over resamples.

    draw(r, i, n) is the place drawn for position i of resample r. Values are one per question.
    """
    n = values.count()
    places = F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.explode(F.array().cast("array<int>"))
    grid = values.sparkSession.range(resamples).toDF("r").select("r", places.alias("i"))  # dealt by resample
    drawn = grid.select("r", draw(F.col("r"), F.col("i"), n).alias("place")).join(values, "place")
    means = drawn.groupBy("r").agg(F.round(F.avg("x"), 9).alias("m")).withColumn("k", F.row_number().over(Window.orderBy("m", "r")) - 1)
    lo, hi = int(round((1 - level) / 2 * resamples, 6)), min(resamples - 1, -int(-round((1 + level) / 2 * resamples, 6) // 1) - 1)
    picked = means.agg(F.max(F.when(F.col("k") == lo, F.col("m"))).alias("lower"), F.max(F.when(F.col("k") == hi, F.col("m"))).alias("upper"))
    point = values.agg(F.avg("x")).first()[0]
    return picked.select(F.round(F.lit(point), 6).alias("point"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


def failure_cause(outside_dates: Column, outside_people: Column, in_lanes: Column, oracle_solves: Column, siblings: Column, distractors: Column, fused_rank: Column) -> Column:
    """Why a target is not among the ten shown; the first that applies."""
    return (
        F.when(outside_dates, "date_misparse").when(outside_people, "filter_excluded").when(~in_lanes & ~oracle_solves, "not_retrieved").when(~in_lanes, "lost_in_fusion")
        .when(siblings >= 3, "crowded_by_dups").when(distractors >= 5, "entity_confusion").when(fused_rank <= 10, "lost_in_rerank").otherwise("lost_in_fusion")
    )


def apportion(shares: DataFrame, total: int) -> DataFrame:
    """shares (name, share) -> name, n: whole numbers that add up to total, by the largest remainders, ties by name."""
    raw = shares.withColumn("raw", F.col("share") * total).withColumn("base", F.floor("raw"))
    left = raw.withColumn("left", F.lit(total) - F.sum("base").over(Window.partitionBy()))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("raw") - F.col("base"), 9)), "name"))
    return left.withColumn("k", rank).select("name", (F.col("base") + F.when(F.col("k") <= F.col("left"), 1).otherwise(0)).alias("n"))


def lane_ceilings(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """hits (qid, id, matched, n_terms), targets (qid, id) -> qid, id, and_ceiling, or_ceiling: the worst ranks that the text lanes can give a target.

    A row with all terms can only lose to others with all of them; one in the fragment lane to those that match as many
    terms. Null where a lane can't find the target.
    """
    own = hits.join(targets, ["qid", "id"]).select("qid", F.col("id").alias("target"), F.col("matched").alias("own"), "n_terms")
    per = hits.groupBy("qid", "matched").agg(F.count(F.lit(1)).alias("n"))  # counts by number of matched terms: few rows a question
    at_least = own.join(per, "qid").where("matched >= own").groupBy("qid", "target", "own", "n_terms").agg(F.sum("n").alias("or_n"), F.sum(F.when(F.col("matched") == F.col("n_terms"), F.col("n"))).alias("and_n"))
    found = at_least.select("qid", F.col("target").alias("id"), F.when(F.col("own") == F.col("n_terms"), F.col("and_n")).alias("and_ceiling"), F.when(F.col("own") >= F.least(F.lit(2), F.col("n_terms")), F.col("or_n")).alias("or_ceiling"))
    return targets.join(found, ["qid", "id"], "left")


def certificate(ceilings: DataFrame, overlap: DataFrame, depth: int) -> DataFrame:
    """ceilings of lane_ceilings, overlap (qid, id, overlap) -> with signals (lanes that must show the target) and solvable."""
    signals = F.array_compact(F.array(F.when(F.col("and_ceiling") <= depth, "and"), F.when(F.col("or_ceiling") <= depth, "or")))
    return ceilings.join(overlap, ["qid", "id"], "left").withColumn("signals", F.array_join(signals, ",")).withColumn("solvable", F.size(signals) > 0)


def oracle_by_family(ranks: DataFrame, lanes: list[str], best_at: int, depth: int) -> DataFrame:
    """ranks (qid, family, a column for each lane with the target's rank or null) -> by family: n, best_lane_hits, depth_hits, by_<lane>."""
    best = F.least(*lanes) if len(lanes) > 1 else F.col(lanes[0])
    return ranks.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(best <= best_at).alias("best_lane_hits"), F.count_if(best <= depth).alias("depth_hits"), *[F.count_if(F.col(c) <= best_at).alias(f"by_{c}") for c in lanes])


def mix_weighted(families: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """families (family, n, recall), shares (family, share) -> weighted, unweighted; without a share a family weighs as its n of all."""
    rows = families.withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row a family
    weight = F.col("n") / F.col("total")
    if shares is not None:
        rows, weight = rows.join(shares, "family", "left"), F.coalesce("share", weight)
    return rows.agg(F.round(F.sum(weight * F.col("recall")) / F.sum(weight), 6).alias("weighted"), F.round(F.avg("recall"), 6).alias("unweighted"), F.count(F.lit(1)).alias("families"))
