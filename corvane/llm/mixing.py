"""Mixing sources to target weights by Poisson replication (operator 6).

A source with share w of the target and n rows is repeated at the rate w * total / n. Each row draws its number of
copies from a Poisson distribution of that mean by inverting it at a number hashed from the row's id, so the draw is
the same on every run and executor. Copies are then put in the order of another hash: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, free_name, hash60

#: A rate over PIECE is drawn as a sum of independent Poisson numbers of means up to PIECE: exp(-rate) can't underflow.
PIECE = 64.0
#: Sources that a broadcast may hold; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column | str) -> Column:
    return hash60(*parts) / F.lit(float(1 << 60))


def cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson number, until the rest is below rounding."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("s"), F.array(F.exp(-mean)).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["s"] + p).alias("s"), F.concat(acc["out"], F.array(acc["s"] + p)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["out"]


def rates(df: DataFrame, source_col: str, weights: dict[str | None, float] | None, total: float | None) -> tuple[DataFrame, int]:
    """source key, rate, pieces and CDF of one piece, one row per source; and how many sources there are."""
    counts = cut(df.groupBy(F.col(source_col).alias("source_key")).agg(F.count(F.lit(1)).alias("n")), "source_counts")
    sources, rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if weights is None:
        share = F.lit(1.0 / max(sources, 1))
    else:
        if any(w < 0 for w in weights.values()) or not sum(weights.values()) > 0:
            raise ValueError("weights must be 0 or more, and not all 0")
        share, whole = F.lit(0.0), float(sum(weights.values()))
        for name, w in weights.items():
            share = F.when(F.col("source_key").eqNullSafe(F.lit(name)), F.lit(w / whole)).otherwise(share)
    rate = share * F.lit(float(rows if total is None else total)) / F.col("n")
    out = counts.select("source_key", rate.alias("rate")).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int"))
    return out.withColumn("cdf", cdf(F.col("rate") / F.col("pieces"))), sources


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str | None, float] | None = None, total: float | None = None, seed: str = "mix") -> DataFrame:
    """df's rows, each as often as drawn, in the global order of a hash; with copy_no (from 1), copies and order_key.

    weights: share of the result by source, on any scale; a source without one gets none. By default all sources get
    the same share. total: rows wanted, by default as many as df has. A null source is one more source; rows that
    repeat an id draw alike and an id of null draws as the text "null". An empty table gives an empty result. Columns of
    df named like the new ones keep their place and the new ones get underscores in front.
    """
    per_source, sources = rates(df, source_col, weights, total)
    if sources <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    copy_no, copies, order = (free_name(df, c) for c in ("copy_no", "copies", "order_key"))
    row_id = F.coalesce(F.col(f"d.{id_col}").cast("string"), F.lit("null"))
    pieces = F.transform(F.sequence(F.lit(1), F.col("s.pieces")), lambda i: F.size(F.filter(F.col("s.cdf"), lambda c: c <= uniform(seed, ":", i, ":", row_id))))
    drawn = F.aggregate(pieces, F.lit(0), lambda a, b: a + b)
    out = df.alias("d").join(per_source.alias("s"), F.col(f"d.{source_col}").eqNullSafe(F.col("s.source_key")))
    out = out.select("d.*", drawn.alias(copies)).where(F.col(copies) > 0)
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy_no))
    out = out.withColumn(order, hash60(seed, ":order:", F.col(copy_no), ":", F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return out.repartitionByRange(parts, order).sortWithinPartitions(order, copy_no)
