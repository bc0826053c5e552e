"""Records: pages and cursors, updates by join, packing into batches, JSON shapes, snapshots of tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of batched writes: rows and bytes of a statement, episodes of a submission, rows and padded tokens of a model's batch.
INSERT_ROWS, INSERT_BYTES, SUBMIT_ROWS, MODEL_ROWS, MODEL_TOKENS = 500, 4 << 20, 8, 64, 6000


def page_of(items: Column, start: int, size: int) -> Column:
    """struct(items, next): a slice of an array from place `start` (0-based), and where the next one starts; null at the end."""
    return F.struct(F.slice(items, start + 1, size).alias("items"), F.when(F.size(items) > start + size, F.lit(start + size)).alias("next"))


def text_page(text: Column, start: int, size: int) -> Column:
    return F.struct(F.substring(text, start + 1, size).alias("part"), F.when(F.length(text) > start + size, F.lit(start + size)).alias("next"))


def next_page(rows: DataFrame, cursors: dict[str, int | None], size: int, kind: str = "kind", key: str = "id") -> DataFrame:
    """kind, key of the next page of several lists that are read side by side, each after its own cursor.

    A list whose cursor is null is exhausted and doesn't start again; one that isn't named starts at its beginning.
    One row more than the page tells whether a list goes on: next is the cursor to come, null where it ends.
    """
    live = [k for k, v in cursors.items() if v is None]
    after = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in cursors.items() if v is not None], F.lit(None).cast("long"))
    rows = rows.where(~F.col(kind).isin(live) & (after.isNull() | (F.col(key) > after))) if cursors else rows
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy(kind).orderBy(key))).where(F.col("nth") <= size + 1)
    ends = nth.groupBy(kind).agg(F.max("nth").alias("found"), F.max(F.when(F.col("nth") == size, F.col(key))).alias("last"))
    return nth.where(F.col("nth") <= size).join(ends, kind).select(kind, key, F.when(F.col("found") > size, F.col("last")).alias("next"))


def update_from(rows: DataFrame, changes: DataFrame, key: str, column: str, guard: Column | None = None) -> DataFrame:
    """rows with column replaced where changes (key, value) has a row and the guard (over rows) holds."""
    known = changes.select(F.col(key).alias("changed_key"), "value", F.lit(True).alias("changed"))
    joined = rows.join(known, F.col(key) == F.col("changed_key"), "left")
    allowed = F.coalesce(F.col("changed"), F.lit(False)) & (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False)))
    return joined.withColumn(column, F.when(allowed, F.col("value")).otherwise(F.col(column))).select(*rows.columns)


def upsert(rows: DataFrame, new: DataFrame, key: list[str], update: bool) -> DataFrame:
    """rows and new, one row a key: a new row replaces the one there, or gives way to it."""
    first, second = (new, rows) if update else (rows, new)
    return first.unionByName(second.join(first.select(*key), key, "left_anti").select(*first.columns))


def pack_batches(rows: DataFrame, group: str, order: str, size: str, most_rows: int, most_size: int, padded: bool = False) -> DataFrame:
    """rows with batch: numbered from 0 in each group. A batch is closed before a row that would make it too long or too large.

    size adds up, or, padded, a batch has the size of its largest row times its rows. A row that is too large by itself is a
    batch of its own. A group is walked in order by one task, row by row, and holds no rows.
    """
    grouped, sized = rows.columns.index(group), rows.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, count, total = None, 0, 0, 0
        for batch in batches:
            out = []
            for of, n in zip(batch.column(grouped).to_pylist(), batch.column(sized).to_pylist(), strict=True):
                grown = max(total, n) * (count + 1) if padded else total + n
                if now is None or of != now[0]:
                    now, number, count, total = (of,), 0, 0, 0
                elif count == most_rows or grown > most_size:
                    number, count, total = number + 1, 0, 0
                count, total = count + 1, max(total, n) if padded else total + n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "batch"])

    placed = rows.repartition(group).sortWithinPartitions(group, order)
    return placed.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())]))


def json_kind(text: Column, path: str = "$") -> Column:
    """object, array, string, number, boolean, null of what stands at a path, missing where nothing does, invalid for what isn't JSON."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    known = (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.isNotNull(), "number").otherwise("missing")
    )
    return F.when(value.isNull(), "invalid").otherwise(known)


def without_keys(rows: DataFrame, dropped: list[str]) -> Column:
    """A row as JSON without some of its columns."""
    return F.to_json(F.struct(*[c for c in rows.columns if c not in dropped]), {"ignoreNullFields": "false"})


def backup(spark: SparkSession, source: str, names: list[str], target: str) -> None:
    """Copies of tables in a folder that must not exist yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"{target} exists: a backup never overwrites, and is restored into an empty place only")
    for name in names:
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{target}/{name}.parquet")


def locator_key(locator: Column) -> Column:
    """What a locator names, without the suffix that an ingestion run has added."""
    return F.regexp_replace(locator, r":(?:turns:[0-9]+|sync:[a-f0-9]{64})$", "")


def observation(rows: DataFrame) -> DataFrame:
    """rows (episode_id, source_id, source_kind, locator, speaker) -> with observation_group, role, fidelity of what was stored before roles were."""
    session = F.col("source_kind").isin("chat_session", "rollout_session") & ~F.coalesce(F.col("locator").startswith("archive:"), F.lit(False))
    key = F.when(session & F.col("locator").isNotNull(), F.concat(F.col("source_id").cast("string"), F.lit(":"), locator_key(F.col("locator"))))
    role = F.when(session & (F.col("speaker") == "owner"), "user").when(session & (F.col("speaker") == "assistant"), "assistant").otherwise("unknown")
    return rows.withColumns({"observation_group": F.coalesce(key, F.col("episode_id").cast("string")), "role": role, "fidelity": F.lit("unknown")})
