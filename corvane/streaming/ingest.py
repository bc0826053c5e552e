"""Structured Streaming: idempotent ingestion through a ledger, event-time windows, running state.

Each job is a restartable micro-batch run (trigger availableNow): what a checkpoint has seen isn't read again, and a
batch that is replayed writes its own folder anew, so a rerun changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import ingest as I
from corvane.operators import temporal as G


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files, or one file: the source watches folders, so a file is picked out of its own by name."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start().awaitTermination()


def ingest_turns(stream: DataFrame, ledger: str, checkpoint: str, key: list[str], order: list[str]) -> None:
    """Append the turns that the ledger doesn't hold yet, repeats counted; a batch's rows are in its own folder."""
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        own = f"{ledger}/batch={batch_id}"
        stored = read_ledger(spark, ledger, batch.schema)
        stored = stored.where(F.col("batch") != batch_id).drop("batch")
        I.new_turns(batch, stored, key, order).write.mode("overwrite").parquet(own)

    run_available(stream, checkpoint, each)


def read_ledger(spark: SparkSession, ledger: str, schema) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(-1))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).option("basePath", ledger).parquet(ledger)


def keep_changes(changes: DataFrame, out: str, checkpoint: str) -> None:
    """The rows that each batch has changed, in a folder of its own: nothing that was written is written again."""
    run_available(changes, checkpoint, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), "update")


def read_latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Each key's row as the last batch that changed it has left it."""
    rows = spark.read.option("basePath", out).parquet(out)
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*columns), "batch").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}") for c in columns])


def windowed_counts(stream: DataFrame, out: str, checkpoint: str, time: str, by: str, width: str, late: str) -> None:
    """Tumbling windows with a watermark: windows that it has passed leave the state, changed ones are written."""
    windows = stream.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width).alias("w"), by)
    counts = windows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    keep_changes(counts.select(F.col("w.start").alias("window_start"), by, "n", "total"), out, checkpoint)


def running_state(stream: DataFrame, out: str, checkpoint: str) -> None:
    """The latest state of each node, kept by the stream's own aggregation; a batch writes the nodes it has changed."""
    keep_changes(G.latest_state(stream), out, checkpoint)
