"""Positions of text lines and parsed rows in file order, without shuffling or copying the rows.

Spark reads a text file as splits (``_metadata.file_block_start``); all lines of one
split sit in one scan partition, contiguous and in file order, but partitions are not in
file order.  So a position in the file is

    position = (rows of the same file in earlier splits) + (rank of the row inside its split)

* the first term comes from a small per-split table (one row per split, ~file size
  / maxPartitionBytes rows) with a running sum per file;
* for *physical* line numbers the rank is ``monotonically_increasing_id() - min(id)``
  over the split (all JVM);
* for *dense* positions of the rows that survive parsing (frame ordinals) a second
  ``monotonically_increasing_id()`` is taken after the filters, so it counts only the
  surviving rows of a scan partition; those before a split follow from the splits' counts.

The counting pass and the reading pass must see the same splits, though Spark sizes splits by
the settings and the cores present when a scan is planned.  So the byte ranges are pinned: a scan
plans its splits by the settings of the session that opened the file relation, and ``scan_lines``
opens it in a session of its own whose split size was fixed once (``pinned_session``).  Whatever changes
later, in cores or settings, every job over these lines reads the same ranges.

The per-split table joins back through a broadcast only after its row count was checked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.sizing import join_small

SPLIT_KEYS = ["file_path", "block_start"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back.

    Used where several jobs read one intermediate result; it cuts the lineage, so a lost
    executor never forces the work before it to be done again."""
    from ..session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SPLIT, _OPEN, _LEAST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"
_PINNED: dict[tuple, SparkSession] = {}


def _bytes(text: str) -> int:
    """A size setting such as ``128MB`` or ``4194304b`` in bytes."""
    digits = text.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(digits[-1:], 0)
    return int(digits.rstrip("kmgt")) << unit


def pinned_session(spark: SparkSession, total: int) -> SparkSession:
    """A session of the same application whose scans of ``total`` bytes split alike from now on.

    Splits have the size Spark would choose now, rounded down to a power of two so that few sessions are kept."""
    largest, opening = _bytes(spark.conf.get(_SPLIT)), _bytes(spark.conf.get(_OPEN))
    size = min(largest, max(opening, total // spark.sparkContext.defaultParallelism, 1))
    size = 1 << (size.bit_length() - 1)
    key = (spark.sparkContext.applicationId, size, opening)
    if key not in _PINNED:
        own = spark.newSession()
        own.conf.set(_SPLIT, f"{size}b")
        own.conf.set(_OPEN, f"{min(opening, size)}b")
        own.conf.set(_LEAST, "1")
        _PINNED[key] = own
    return _PINNED[key]


def scan_lines(spark: SparkSession, paths) -> DataFrame:
    """Raw lines with file path, split start and a scan-order id (``mid``), in pinned byte ranges.

    Lines end at a line feed; a carriage return before it stays in the line (parsing trims it)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    total = int(str(spark.read.text(paths)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    lines = pinned_session(spark, total).read.option("lineSep", "\n").text(paths).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("mid"),
    )
    # a global view hands the relation over to the caller's session
    name = f"lines_{uuid.uuid4().hex}"
    lines.createGlobalTempView(name)
    try:
        return spark.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def split_table(lines: DataFrame, is_frame: Column, is_bad: Column) -> DataFrame:
    """One row per split of ``lines``, by one pass: counts, and where its lines and frames begin.

    ``line_base``, ``row_base``: lines and frames of the file before the split; ``first_rid``: the id that
    ``monotonically_increasing_id`` gives its first frame when only frames are left in the scan."""
    stats = lines.groupBy(*SPLIT_KEYS).agg(
        F.first("file_size").alias("file_size"), F.min("mid").alias("min_mid"), F.count(F.lit(1)).alias("n_lines"), F.count_if(is_frame).alias("n_frames"),
        F.count_if(is_bad).alias("n_bad"), F.min(F.when(is_bad, F.col("mid"))).alias("bad_mid"), F.sum(F.octet_length("value") + 1).alias("n_bytes"))
    stats = _split_bases(_split_bases(stats, "n_lines", "line_base"), "n_frames", "row_base")
    part = F.shiftright("min_mid", 33)
    earlier = Window.partitionBy(part).orderBy("min_mid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("first_rid", F.shiftleft(part, 33) + F.coalesce(F.sum("n_frames").over(earlier), F.lit(0)))
    return stats.checkpoint()


def numbered(rows: DataFrame, splits: DataFrame, position_col: str = "ordinal") -> DataFrame:
    """Dense 0-based position of ``rows``, the frames of the scan that ``splits`` describes, in file order.

    ``rows`` must come from the scan through narrow operations only (filters and projections)."""
    joined = _join_split_table(rows.withColumn("_rid", F.monotonically_increasing_id()), splits.select(*SPLIT_KEYS, "row_base", "first_rid"))
    pos = (F.col("row_base") + F.col("_rid") - F.col("first_rid")).cast("bigint")
    return joined.withColumn(position_col, pos).drop("row_base", "first_rid", "_rid")


def _split_bases(counts: DataFrame, count_col: str, base_col: str) -> DataFrame:
    """Running sum of ``count_col`` over the earlier splits of the same file."""
    w = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(base_col, F.coalesce(F.sum(count_col).over(w), F.lit(0)).cast("bigint"))


# One row per split; with the compact key a row is four longs, so even ~800 000 splits
# (100 TB at 128 MB) stay a ~25 MB broadcast.
MAX_SPLIT_ROWS_COMPACT = 1_000_000
# The compact key is used when no two paths share a hash; False forces the path key.
USE_COMPACT_SPLIT_KEY = True


def _join_split_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join the per-split table back to the rows without shuffling the rows.

    The table is checkpointed (so the size check and the join read it once).  It is
    keyed by ``(xxhash64(file_path), block_start)`` when no two paths share a hash
    (checked exactly on the small table), which makes a row four longs; otherwise by the
    path itself.  Above the bound the join is left to a shuffle join."""
    n_paths = table.select("file_path").distinct().count()
    n_hashes = table.select(F.xxhash64("file_path").alias("h")).distinct().count()
    if USE_COMPACT_SPLIT_KEY and n_paths == n_hashes:
        compact = table.withColumn("_fid", F.xxhash64("file_path")).drop("file_path")
        keyed = rows.withColumn("_fid", F.xxhash64("file_path"))
        return join_small(keyed, compact, ["_fid", "block_start"], max_rows=MAX_SPLIT_ROWS_COMPACT).drop("_fid")
    return join_small(rows, table, SPLIT_KEYS)


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add ``line_no`` (1-based physical line number in its file) to ``scan_lines`` rows (or a projection of them)."""
    stats = lines.groupBy(*SPLIT_KEYS).agg(F.min("mid").alias("min_mid"), F.count(F.lit(1)).alias("n_lines"))
    # Small (one row per split): materialise once in the shared checkpoint folder so the
    # size check and the join do not each re-read the text.
    stats = _split_bases(stats, "n_lines", "line_base").select(*SPLIT_KEYS, "min_mid", "line_base").checkpoint()
    joined = _join_split_table(lines, stats)
    return joined.withColumn("line_no", F.col("line_base") + F.col("mid") - F.col("min_mid") + 1).drop(
        "min_mid", "line_base"
    )


def dense_positions(rows: DataFrame, position_col: str = "ordinal") -> DataFrame:
    """Dense 0-based position of ``rows`` within their file, in file order.

    ``rows`` carry ``_rid``, a ``monotonically_increasing_id`` over one scan whose rows stay put (persisted ones,
    as of a micro-batch).  Rows of one split are contiguous in its scan partition, so the rank inside the split is
    ``_rid - min(_rid)``.  The per-split minimum and count come from one small aggregate; no
    shuffle of the rows and no Python."""
    stats = rows.groupBy(*SPLIT_KEYS).agg(F.min("_rid").alias("min_rid"), F.count(F.lit(1)).alias("n_rows"))
    bases = _split_bases(stats, "n_rows", "row_base").select(*SPLIT_KEYS, "min_rid", "row_base").checkpoint()
    joined = _join_split_table(rows, bases)
    pos = (F.col("row_base") + F.col("_rid") - F.col("min_rid")).cast("bigint")
    return joined.withColumn(position_col, pos).drop("row_base", "min_rid", "_rid")
