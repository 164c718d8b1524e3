"""Exact deduplication through an extendible-hash index on shared files (DataFrame code only).

Each text is normalised (lower-cased A-Z) and hashed to 64 bits.  The index:

* ``directory``: 2**depth slots (upper hash bits) -> bucket and its local depth.  It starts with
  one bucket; while a bucket holds more than ``capacity`` hashes it splits on its next bit, and
  the directory doubles when that bit is beyond its depth.  The result depends only on counts by
  prefix, so it is computed from those, at as many bits as the counts ask for;
* ``entries``: one for each distinct text, with its bytes, in the files of its bucket's owner.

A bucket is a range of hashes, and its rows go to one owner task.  There rows that share a hash form a chain:
sorted by their bytes, each is compared with the one before it, and where the bytes differ a new entry starts.
So hashes only bring rows together; bytes alone tell texts apart.  A lookup (``probe``) goes through the
directory to a bucket, along the chain there, and compares bytes.

Hot hashes (``hot_over`` says which; at most ``HOT_ROWS`` of them) are pre-aggregated: rows of equal text are summed
in each task before they go to the owner, where they are one link of the chain; their documents read the owner's
entries back.

Null text counts as empty; equal rows are copies of one another; a null id is never the row
that stays unless all ids of its group are null; other columns are left out; an empty table
gives an empty index and result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import partitions_for, small, small_bytes, written

#: Hashes a bucket holds before it splits.
CAPACITY = 1024
#: Hashes with many rows that are told to all tasks, at most, and the rows that make one hot at least.
HOT_ROWS, HOT = 50_000, 1000
#: Input bytes of an owner task, about.
OWNED_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _norm(docs: DataFrame, text_col: str) -> Column:
    return F.translate(F.coalesce(docs[text_col], F.lit("")), _UPPER, _LOWER)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), _norm(docs, text_col).alias("norm"))
    return rows.select("doc_id", "norm", F.xxhash64("norm").alias("hash"))


def slot(depth: int, column: str = "hash") -> Column:
    """The directory slot of a hash: its upper ``depth`` bits."""
    return F.lit(0).cast("bigint") if depth == 0 else F.shiftrightunsigned(F.col(column), 64 - depth)


def hot_over(rows: int) -> int:
    """Rows above which a hash is hot: so many that fewer than ``HOT_ROWS`` hashes can be."""
    return max(HOT, rows // HOT_ROWS)


def split_bits(hashes: DataFrame, capacity: int) -> int:
    """Bits at which no bucket holds more than ``capacity`` hashes."""
    n = hashes.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / capacity))) + 2
    while bits < 63:
        fullest = hashes.groupBy(slot(bits).alias("prefix")).count().agg(F.max("count")).first()[0]
        if fullest is None or fullest <= capacity:
            break
        bits += 2
    return bits


def directory_of(hashes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) and the depth after all splits; a bucket is named by its first hash bits.

    ``hashes`` are distinct.  A prefix is a bucket if it holds ``capacity`` hashes at most and its parent holds more."""
    spark = hashes.sparkSession
    bits = split_bits(hashes, capacity)
    counts = hashes.groupBy(slot(bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.select(F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("local_depth"), "prefix", "n")
    levels = levels.groupBy("local_depth", F.expr(f"shiftright(prefix, {bits} - local_depth)").alias("prefix")).agg(F.sum("n").alias("n"))
    levels = written(levels, "levels")
    full = levels.where(F.col("n") > capacity).select("local_depth", "prefix")
    # the children of overfull buckets, empty ones too, and the first bucket
    born = full.select((F.col("local_depth") + 1).alias("local_depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    born = born.unionByName(spark.createDataFrame([(0, 0)], "local_depth int, prefix bigint"))
    buckets = written(born.join(full, ["local_depth", "prefix"], "left_anti"), "buckets")
    depth = buckets.agg(F.max("local_depth")).first()[0]
    first = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    slots = buckets.select(first.alias("bucket"), "local_depth", F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - local_depth)") - 1)).alias("slot"))
    return slots.select("slot", "bucket", "local_depth"), depth


def _owned(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """``rows`` with their bucket."""
    return rows.withColumn("slot", slot(depth)).join(small(directory.select("slot", "bucket"), 1 << 20), "slot").drop("slot")


def _chained(rows: DataFrame, directory: DataFrame, depth: int, owners: int) -> DataFrame:
    """(doc_id, n, hot, bucket, hash, entry, keep_id, group_size, text_sha256, norm) of rows (doc_id, n, hot, hash, norm).

    Each bucket is in one task.  ``norm`` is kept at the first row of an entry only."""
    chain = Window.partitionBy("bucket", "hash").orderBy("norm", F.col("doc_id").desc_nulls_last())
    rows = _owned(rows, directory, depth).repartition(owners, "bucket")
    starts = F.lag("norm").over(chain).isNull() | (F.lag("norm").over(chain) != F.col("norm"))
    rows = rows.withColumn("starts", starts).withColumn("entry", F.sum(F.col("starts").cast("bigint")).over(chain))
    rows = rows.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("norm", F.when(F.col("starts"), F.col("norm")))
    entry = Window.partitionBy("bucket", "hash", "entry")
    return rows.select("doc_id", "n", "hot", "bucket", "hash", "entry", F.max("doc_id").over(entry).alias("keep_id"), F.sum("n").over(entry).alias("group_size"), "text_sha256", "norm")


def build_index(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of ``docs`` to ``path`` (a folder that all executors share)."""
    spark = docs.sparkSession
    hashes = written(keyed(docs, id_col, text_col).groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hashes")
    slots, depth = directory_of(hashes, capacity)
    slots.withColumn("depth", F.lit(depth)).write.parquet(f"{path}/directory")
    directory = spark.read.parquet(f"{path}/directory")
    total = hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hashes.where(F.col("n") > hot_over(total)).select("hash")
    hot.write.parquet(f"{path}/hot")
    hot = F.broadcast(spark.read.parquet(f"{path}/hot"))  # HOT_ROWS rows at most
    rows = keyed(docs, id_col, text_col)
    many = rows.join(hot, "hash", "left_semi").groupBy("hash", "norm").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    few = rows.join(hot, "hash", "left_anti").select("hash", "norm", "doc_id", F.lit(1).cast("bigint").alias("n"))
    rows = few.withColumn("hot", F.lit(False)).unionByName(many.withColumn("hot", F.lit(True)))
    owners = partitions_for(docs, OWNED_BYTES)
    _chained(rows, directory, depth, owners).write.parquet(f"{path}/entries")


def entries(spark, path: str) -> DataFrame:
    """(bucket, hash, norm, keep_id, group_size, text_sha256): one row for each distinct text."""
    return spark.read.parquet(f"{path}/entries").where(F.col("norm").isNotNull()).select("bucket", "hash", "norm", "keep_id", "group_size", "text_sha256")


def probe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its entry in the index (nulls if its text isn't there), found by bucket, hash and bytes."""
    spark = docs.sparkSession
    directory = spark.read.parquet(f"{path}/directory")
    asked = _owned(keyed(docs, id_col, text_col), directory, directory.first()["depth"])
    return asked.join(entries(spark, path), ["bucket", "hash", "norm"], "left").select("doc_id", "keep_id", "group_size", "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    path = scratch_path(spark, "exact-index")
    build_index(docs, path, capacity, id_col, text_col)
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    found = spark.read.parquet(f"{path}/entries").where(~F.col("hot")).select(*columns)
    hot = spark.read.parquet(f"{path}/hot")
    if not hot.isEmpty():
        hot = F.broadcast(hot)  # HOT_ROWS rows at most
        asked = keyed(docs, id_col, text_col).join(hot, "hash", "left_semi")
        known = entries(spark, path).join(hot, "hash", "left_semi").drop("bucket")
        found = found.unionByName(asked.join(small_bytes(known, "norm"), ["hash", "norm"]).select(*columns))
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one for each distinct text (see ``exact_groups``)."""
    found = written(exact_groups(docs, id_col, text_col), "exact-groups")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha")).distinct()
    rows = docs.withColumn("_sha", F.sha2(_norm(docs, text_col), 256))
    rows = rows.join(small(gone), docs[id_col].cast("bigint").eqNullSafe(F.col("_gone_id")) & (F.col("_sha") == F.col("_gone_sha")), "left_anti")
    # rows that repeat id and text are all marked as kept; one of them stays
    twice = found.where("kept").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    if not twice.isEmpty():
        rows = rows.dropDuplicates(["_sha"])
    return rows.drop("_sha")
