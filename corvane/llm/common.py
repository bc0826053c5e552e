"""What the corpus operators share: scratch tables in the cluster's shared folder, portable hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This session's scratch folder under spark.checkpoint.dir, removed when the driver ends.

    Only where that setting is absent (a local test) does it fall back to a temporary folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        root = f"{base.rstrip('/')}/corvane-{uuid.uuid4().hex[:12]}"
        _roots[app] = root
        atexit.register(_remove, spark, root)
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is already gone: the shared folder's own clean-up has it
        return


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, any executor may be lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_holder: list = []


def hold(name: str, forget: Callable[[], object]) -> None:
    """For the start of a task in a Python worker, which lives on from task to task and from operator to operator.

    What the operator before has kept there (forget() drops it) is given up when another one comes, back to the system.
    """
    if _holder and _holder[0] != name:
        _holder[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    _holder[:] = [name, forget]


def hash60(*parts: Column | str) -> Column:
    """0 <= value < 2^60 from the MD5 of the parts: the same number in any SQL engine."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bytes of one Arrow batch between the JVM and a Python worker: long texts then come few at a time.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded by bytes, for functions that take whole texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """df's rows whose id isn't among ids. Where those are few, Spark broadcasts them and the texts don't move."""
    name = free_name(df, "gone_id")
    gone = cut(ids.toDF(name).distinct(), "gone")
    return df.join(gone, F.col(id_col) == F.col(name), "left_anti")
