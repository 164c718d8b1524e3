"""Shared helpers of the training-data operators: session set-up, scratch tables, sizes."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import DEFAULT_MAX_BROADCAST_ROWS
from ..session import ensure_checkpoint_dir, scratch_path, ship_package

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts that go to a Python worker at a time, at most.
TEXT_BATCH_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Prepare the session for Python stages over whole texts.

    The package is made importable on the executors and Arrow batches are held to
    ``TEXT_BATCH_ROWS`` rows, as Spark bounds them by rows only and texts can be long."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if not 0 < int(spark.conf.get(_ARROW_ROWS)) <= TEXT_BATCH_ROWS:
        spark.conf.set(_ARROW_ROWS, str(TEXT_BATCH_ROWS))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder, read back: cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int | None:
    """Spark's size estimate of ``df``; None where it has none worth using."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if 0 <= size < 1 << 60 else None


def partitions_for(df: DataFrame, target_bytes: int) -> int:
    """Partitions of about ``target_bytes`` of input each, at least one."""
    size = input_bytes(df)
    if size is None:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(size / target_bytes))


def small(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``max_rows`` rows or fewer; counted first."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_bytes(df: DataFrame, text_col: str, max_bytes: int = 8 << 20, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its texts hold ``max_bytes`` at most; measured first."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def small_lists(df: DataFrame, list_col: str, max_items: int = 500_000, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows and its lists ``max_items`` entries at most; measured first."""
    n, items = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(list_col)), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and items <= max_items else df


#: Rows of one key from which ``join_counted`` treats it as hot, at least, and hot keys at most.
HOT, HOT_KEYS = 1000, 50_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``, whose ``count`` says how many of the ``total`` rows hold each key.

    Keys of many rows, fewer than ``HOT_KEYS``, are joined by broadcast, so no task gets all rows of one; the
    rest by a shuffle.  ``rows`` and ``table`` are read twice; null keys join nothing."""
    many = max(HOT, total // HOT_KEYS)
    payload = [c for c in table.columns if c not in (*keys, count)]
    marked = rows.join(F.broadcast(table.where(F.col(count) > many).drop(count).withColumn("_hot", F.lit(True))), keys, "left")
    hot = marked.where(F.col("_hot")).drop("_hot")
    return hot.unionByName(marked.where(F.col("_hot").isNull()).drop("_hot", *payload).join(table.where(F.col(count) <= many).drop(count), keys))


#: What a worker keeps from task to task (an encoder and its memo), by its key.
KEPT: dict = {}


def drop_kept() -> None:
    """Drop what this worker keeps.  Named by the closures, which would carry a copy of ``KEPT``."""
    if KEPT:
        KEPT.clear()
        give_back()


def give_back() -> None:
    """Return the memory that this worker's allocators hold but don't use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a Python stage, whose worker gives freed memory back when a task ends.

    Spark keeps workers for later stages; what their allocators hold would count there.  So
    would an encoder: a stage that doesn't say it ``keeps`` one drops that of earlier stages."""

    def wrapped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_kept()
        try:
            yield from run(parts)
        finally:
            give_back()

    return wrapped


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't among those of ``gone`` (null counts as an id)."""
    ids = written(gone.select(F.col("doc_id").alias("_gone_id")).distinct(), "gone")
    return docs.join(small(ids), docs[id_col].cast("bigint").eqNullSafe(F.col("_gone_id")), "left_anti")
