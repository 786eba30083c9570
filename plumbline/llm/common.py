"""Helpers shared by the corpus operators: shared scratch storage, size-checked broadcasts, skew-safe row keys."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch of texts.
TEXT_BATCH_ROWS = 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is empty and all runs in one process (tests), a temporary folder is made and set; on a
    cluster an empty setting is an error, as executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    # a path without a scheme belongs to the cluster's default file system
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone; leftover scratch is harmless
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation, and every later reader sees
    the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it fits ``limit``; else as it is, for a shuffled join.

    ``df`` should be materialized, as it is counted here. Where rows hold texts or lists, ``row_bytes`` is their
    size as an expression, which is summed over all rows.
    """
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, changed where needed so that none is a column of ``names`` (in any case of letters)."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Returns what this process has freed to the system, which allocators else keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function``, and at its end ``give_back``: workers outlive their tasks, and what one keeps comes on top of the next task's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def map_text(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow``, in batches of at most ``TEXT_BATCH_ROWS`` rows, as texts are wide and a worker's memory is small.

    The limit is a session setting; it is only ever lowered. Workers give a task's memory back when it ends.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_BATCH_ROWS:
        conf.set(name, str(TEXT_BATCH_ROWS))
    return df.mapInArrow(released(function), schema)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 128-bit key of a document row that also tells apart rows of one id, and rows without an id."""
    content = (F.col(doc_id), F.coalesce(F.col(text), F.lit("\0null")))
    return F.struct(F.xxhash64(F.lit("row"), *content).alias("a"), F.xxhash64(F.lit("row again"), *content).alias("b"))
