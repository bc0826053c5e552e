"""Exact deduplication by a tree merge of sorted digest runs (operator 7, DataFrame operations only).

Each partition of the table makes a run: its rows, sorted by digest, reduced to one entry per digest where they are
read. Runs are merged in binomial rounds: every FAN_IN (2^2) neighbours meet and become one. So that the last run isn't
one task, digests are cut into ranges (lanes, as many as shuffle partitions), and runs meet lane by lane: a round deals
entries by (lane, merged run), sorts the pieces of runs that meet in a task by digest, and keeps the best entry of each
digest. A digest that holds a third of all rows comes as at most FAN_IN entries a task (in the first round as one of
each partition of the runs that meet), never as rows.

An entry holds the winner so far and the number of rows behind it. What makes it one text is the SHA-256, the length
and a 64-bit hash of the normalised text, all three verified at every level. Texts aren't compared themselves: for 10^12
different texts the SHA-256 alone has a collision with a probability under 10^-52.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, free_name, without

#: Runs are the table's partitions, but no more than MOST_RUNS: beyond, neighbouring partitions make one run.
MOST_RUNS, FAN_IN = 4096, 4
#: Characters that don't count, as a fixed value of the contract: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
KEY = ["digest", "norm_len", "second"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (code points of the original), and the key of the normalised text: SHA-256, its length, an xxhash64."""
    n, norm = F.length(F.coalesce(F.col(text_col), F.lit(""))), normalised(F.col(text_col))
    return df.select(F.col(id_col).alias("id"), n.alias("n"), norm.alias("norm")).select(
        "id", "n", F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"), F.length("norm").alias("norm_len"), F.xxhash64("norm").alias("second")
    )


def merge_runs(prints: DataFrame, runs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per key: the winning id and the number of rows. Rounds: runs, then runs / fan_in, ... then one.

    prints must be a table that is read the same way again, since a run is told by its partition.
    """
    lanes = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    partitions = 1 + (prints.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0)
    runs = min(partitions, MOST_RUNS) if runs is None else runs
    lane = F.floor(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") * lanes / F.lit(1 << 32)).cast("int")
    run = F.floor(F.least(F.spark_partition_id(), F.lit(partitions - 1)).cast("long") * runs / F.lit(partitions))
    best = F.struct((-F.col("n")).alias("neg_n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    level = prints.select(lane.alias("lane"), run.alias("run"), *KEY, best.alias("best"), F.lit(1).cast("long").alias("size"))
    by, dealt = ["lane", "run", *KEY], False
    while True:
        runs = -(-runs // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        if dealt:  # in the first round Spark's partial aggregate makes the runs before anything moves
            level = level.repartition(lanes, "lane", "run")
        level = level.sortWithinPartitions(*by).groupBy(*by).agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        dealt = True
        if runs <= 1:
            return level.select(*KEY, F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without BLANKS; null counts as empty. Of equal texts the row with the most
    code points stays, then the smallest id; a null id comes last. Rows that repeat the winner's id are all marked kept
    (keep_unique drops the repeats). An empty table gives an empty result; other columns are ignored.
    """
    prints = cut(fingerprints(df, id_col, text_col), "digests")
    merged = merge_runs(prints)
    return prints.join(merged, KEY).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_unique(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without its dropped rows, with df's columns; a repeated row of the winner's id stays once.

    Where every row has an id of its own, dropped ids are enough. Else rows are numbered, and of a winner's rows with the
    most code points that with the smallest number stays: numbers move, whole rows only where they are read again.
    """
    marks = cut(exact_dedup(df.select(id_col, text_col), id_col, text_col), "marks")
    if marks.where(F.col(id_col).isNull()).isEmpty() and marks.groupBy(id_col).count().where("count > 1").isEmpty():
        return without(df, id_col, marks.where("not kept").select(id_col))
    number = free_name(df, "row_number")
    rows = cut(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    winners = marks.where("kept").select(F.col(id_col).alias("winner"), F.col("text_sha256").alias("digest")).distinct()
    own = rows.select(F.col(number).alias("n"), F.col(id_col).alias("id"), F.length(text_col).alias("size"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"))
    own = cut(own, "numbered_digests")
    stays = own.join(winners, F.col("id").eqNullSafe(F.col("winner")) & (own["digest"] == winners["digest"])).groupBy(own["digest"])
    stays = stays.agg(F.min(F.struct((-F.coalesce("size", F.lit(0))).alias("neg"), F.col("n").alias("n")))["n"].alias("n"))
    return without(rows, number, own.join(stays.select("n"), "n", "left_anti").select("n")).drop(number)
