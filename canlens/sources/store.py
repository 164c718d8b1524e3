"""Saved traces as Parquet, and lookups on them.

``save_trace`` deals frames to files of a planned size by ``(trace_id, ordinal)`` and sorts each output
file by ordinal, so every file and row group covers a contiguous ordinal (and, for
time-ordered traces, time) range: Parquet min/max statistics then skip what a lookup
does not need.  ``chunk_id = ordinal div chunk_size`` replaces the reference's chunk
directory; ``chunk_summary`` is the small per-chunk table used to skip chunks by time.
The lookups are plain filters/aggregates — no in-memory index structure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.summary import cache_summary, chunk_summary
from ..plans.sizing import join_small
from ..session import delete_shared, scratch_path
from .lines import materialize

DEFAULT_CHUNK_SIZE = 4096


# A bound per file where the caller gives the number of files: about 1-2 GB of Parquet at ~40 bytes a frame.
DEFAULT_MAX_RECORDS_PER_FILE = 40_000_000
#: Bytes of a file of a planned store.
TARGET_BYTES = 512 << 20
#: Rows of the sample that is written to measure the bytes of a row, about.
SAMPLE_ROWS = 200_000
#: Frames that make a file of its own worth while, as long as there are fewer files than cores.
LEAST_ROWS = 10_000
#: Files whose frames are cut off one running count.
SPAN_FILES = 1000


def _sorted_rows(frames: DataFrame, chunk_size: int) -> DataFrame:
    return frames.withColumn("chunk_id", F.floor(F.col("ordinal") / F.lit(chunk_size)).cast("bigint"))


def _writer(rows: DataFrame, mode: str, id_bloom_filter: bool):
    w = rows.sortWithinPartitions("trace_id", "ordinal").write.mode(mode)
    return w.option("parquet.bloom.filter.enabled#can_id", "true") if id_bloom_filter else w


def row_bytes(frames: DataFrame, total: int, id_bloom_filter: bool = False) -> float:
    """Bytes of a stored row, measured on a written sample of whole stretches of 4096 ordinals."""
    spark = frames.sparkSession
    share = max(1, total // SAMPLE_ROWS)
    picked = frames.where(F.pmod(F.xxhash64("trace_id", F.shiftright("ordinal", 12)), F.lit(share)) == 0)
    path = scratch_path(spark, "row-bytes")
    _writer(_sorted_rows(picked, DEFAULT_CHUNK_SIZE).coalesce(1), "overwrite", id_bloom_filter).parquet(path)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    rows = spark.read.parquet(path).count()
    delete_shared(spark, path)
    return size / rows if rows else 64.0


def file_plan(frames: DataFrame, rows_per_file: int) -> tuple[DataFrame, int]:
    """(trace_id, cell, file) and the number of files: which file each stretch of ordinals goes to.

    Frames are counted by trace and *cell* (an eighth of a file's rows, by ordinal).  Spans of traces, dealt by hash,
    each cut their running count into equal files; small traces share a file, long ones have many."""
    bits = max(0, (rows_per_file // 8).bit_length() - 1)
    cells = frames.groupBy("trace_id", F.shiftright("ordinal", bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(cells, "cells")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spans = max(1, total // (SPAN_FILES * rows_per_file))
    cells = cells.withColumn("span", F.pmod(F.xxhash64("trace_id"), F.lit(spans)))
    per_span = cells.groupBy("span").agg(F.sum("n").alias("rows")).withColumn("files", F.greatest(F.lit(1), F.round(F.col("rows") / rows_per_file)).cast("bigint"))
    # one row for each SPAN_FILES files or so
    per_span = per_span.withColumn("base", F.sum("files").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("span").orderBy("trace_id", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("before", before).join(per_span, "span")
    number = F.coalesce("base", F.lit(0)) + F.floor((F.col("before") + F.col("n") / 2) * F.col("files") / F.col("rows")).cast("bigint")
    plan = materialize(placed.select("trace_id", "cell", number.cast("int").alias("file")), "file-plan")
    return plan, int(plan.agg(F.coalesce(F.max("file"), F.lit(0))).first()[0]) + 1


def save_trace(frames: DataFrame, path: str, chunk_size: int = DEFAULT_CHUNK_SIZE, files: int | None = None,
               mode: str = "overwrite", id_bloom_filter: bool = True,
               max_records_per_file: int = DEFAULT_MAX_RECORDS_PER_FILE, target_bytes: int = TARGET_BYTES) -> str:
    """Write frames (any source) as a chunked, ordinal-sorted Parquet store.

    Each file holds contiguous ordinals, sorted by ``(trace_id, ordinal)`` (min/max statistics
    prune ordinal and time lookups); a Parquet bloom filter on ``can_id`` lets id lookups
    skip row groups although the data is not sorted by id.  The number of files follows the data: the bytes of a
    row are measured on a sample, and ``file_plan`` cuts the traces into files of ``target_bytes`` or so, however
    many traces there are and whichever holds most frames.  ``files`` gives the number instead (range
    partitioning, ``max_records_per_file`` rows at most in each)."""
    spark = frames.sparkSession
    out = _sorted_rows(frames, chunk_size)
    if files is not None:
        ranged = out.repartitionByRange(files, "trace_id", "ordinal")
        _writer(ranged, mode, id_bloom_filter).option("maxRecordsPerFile", str(max_records_per_file)).parquet(path)
        return path
    total = frames.count()
    per_file = max(1, round(target_bytes / row_bytes(frames, total, id_bloom_filter)))
    per_file = min(per_file, max(LEAST_ROWS, -(-total // spark.sparkContext.defaultParallelism)))
    plan, n = file_plan(frames, per_file)
    bits = max(0, (per_file // 8).bit_length() - 1)
    numbered = join_small(out.withColumn("cell", F.shiftright("ordinal", bits)), plan, ["trace_id", "cell"])
    _writer(numbered.repartitionById(n, F.col("file")).select(*out.columns), mode, id_bloom_filter).parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Open a saved trace."""
    return spark.read.parquet(path)


def read_chunk(store: DataFrame, chunk_id: int, trace_id: str | None = None) -> DataFrame:
    """All frames of one chunk (pruned by row-group statistics)."""
    df = store.filter(F.col("chunk_id") == chunk_id)
    return df if trace_id is None else df.filter(F.col("trace_id") == trace_id)


def lookup_time_range(frames: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """First and last ordinal with ``start <= ts <= end`` per trace, and a match flag.

    Order-free: works on traces that are not time-sorted.  A trace without a hit has a row
    with ``matched`` false and null ordinals."""
    hit = F.col("timestamp_ns").between(start_ns, end_ns)
    return frames.groupBy("trace_id").agg(
        F.min(F.when(hit, F.col("ordinal"))).alias("first_ordinal"), F.max(F.when(hit, F.col("ordinal"))).alias("last_ordinal"),
        (F.count_if(hit) > 0).alias("matched"))


def lookup_id(frames: DataFrame, can_id: int) -> DataFrame:
    """All ordinals of an id, in order (I4)."""
    return frames.filter(F.col("can_id") == can_id).select("trace_id", "ordinal").orderBy("trace_id", "ordinal")


def lookup_ordinal(frames: DataFrame, ordinal: int) -> DataFrame:
    """The frame at an ordinal, or no row."""
    return frames.filter(F.col("ordinal") == ordinal)


def build_chunk_summary(store: DataFrame, chunk_size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """Per-chunk count, first/last timestamp and channels."""
    return chunk_summary(store, chunk_size, F.array_sort(F.collect_set("channel")).alias("channels"),
                         F.min("timestamp_ns").alias("min_timestamp_ns"), F.max("timestamp_ns").alias("max_timestamp_ns"))


def store_summary(chunks: DataFrame) -> DataFrame:
    """Whole-store summary from the chunk table."""
    return cache_summary(chunks)


def store_range(store: DataFrame, start_ns: int, end_ns: int, channel: int | None = None) -> DataFrame:
    """Frames in ``[start, end]``, of one channel (I8, I7): both predicates reach the scan, which
    skips by the statistics of the sorted files."""
    df = store.filter(F.col("timestamp_ns").between(start_ns, end_ns))
    return df if channel is None else df.filter(F.col("channel") == channel)
