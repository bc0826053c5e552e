"""Table scans. A path is anything Spark's readers accept: local, HDFS, object store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """A table that need not be there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return table(spark, sf_dir, name) if there else None


def parse_lines(files: DataFrame) -> DataFrame:
    """files (path, value) -> path, line (from 1), v (a VARIANT) and error of every line that isn't blank."""
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("at", "raw")).where(F.trim("raw") != "")
    v = F.try_parse_json("raw")
    error = F.when(v.isNull(), F.concat(F.col("path"), F.lit(": line "), F.col("at") + 1, F.lit(" isn't JSON")))
    return rows.select("path", (F.col("at") + 1).alias("line"), v.alias("v"), error.alias("error"))
