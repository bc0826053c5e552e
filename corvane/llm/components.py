"""Connected components by alternating large and small stars, on DataFrames with checkpointed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges (a, b); nodes are long.

    In each round a node's larger neighbours are hung on the smallest of its neighbourhood, then its smaller ones. Rows
    never exceed the edges given; components of any size need rounds in the order of the square of a logarithm.
    """

    def hung(rows: DataFrame, low: DataFrame) -> DataFrame:
        # The second key is 0 everywhere. By the first alone, the rows would join in the stage that takes the minimum;
        # with both, two fresh shuffles meet, and adaptive execution can split the rows of a hub.
        low = low.select(F.col("a").alias("low_a"), "m")
        return rows.join(low, (F.col("a") == F.col("low_a")) & (F.col("a") % 1 == F.col("low_a") % 1))

    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = hung(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = hung(large, low).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a != b").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
    raise RuntimeError("components did not settle")
