"""Minimax contiguous partition of documents into shards (DataFrame code only).

Groups of equal texts are atomic and lie in one order (by the texts' SHA-256).  The smallest
shard capacity for which a greedy pass needs no more than the given number of shards is found
by search, and the shards are cut where the greedy pass at that capacity cuts.

Rows are range-partitioned once by (text hash, document id) and written with their position
in their part; a running sum over the parts' totals (one row per part) makes positions global.
A hot text is spread over parts, as the document id is part of the order.  A greedy step for
capacity c asks for the last group that ends at or before a bound: one aggregate over the
sorted group table, asked for ``PROBES`` capacities at a time, so that the search takes
log(range) / log(PROBES + 1) rounds.

Size of a row: UTF-8 bytes of its text plus 1 (null: 1, the same group as empty texts).
Repeated rows count each; other columns are left out; an empty table gives an empty result;
with fewer groups than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import input_bytes, small, written

#: Capacities tried in one round of the search.
PROBES = 31
#: Estimated bytes of rows (without their texts) that go to one part.
PART_BYTES = 16 << 20


def _ordered(docs: DataFrame, id_col: str, text_col: str, parts: int | None) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    parts = parts or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (input_bytes(docs) or 0) // (8 * PART_BYTES))
    rows = rows.repartitionByRange(parts, "group", "doc_id").sortWithinPartitions("group", "doc_id")
    at = F.monotonically_increasing_id()
    return written(rows.select("*", F.shiftrightunsigned(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "shard-rows")


def _running(totals: DataFrame, column: str, name: str) -> DataFrame:
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return totals.select("part", F.coalesce(F.sum(column).over(order), F.lit(0)).alias(name))


def _groups(rows: DataFrame) -> DataFrame:
    """(part, at) of each group's first row, and the bytes before and after the group, in order."""
    first = F.min(F.struct("part", "at"))
    groups = rows.groupBy("group").agg(first.alias("first"), F.sum("size").alias("size")).select("first.part", "first.at", "size")
    base = _running(groups.groupBy("part").agg(F.sum("size").alias("bytes")), "bytes", "base")
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = groups.withColumn("within", F.sum("size").over(inside)).join(small(base), "part")
    ends = ends.select("part", "at", "size", (F.col("base") + F.col("within")).alias("end"))
    return written(ends.withColumn("begin", F.col("end") - F.col("size")), "shard-groups")


def _greedy(groups: DataFrame, capacities: list[int], shards: int, total: int) -> list[list[int]]:
    """Ends of the greedy shards for each capacity, ``shards`` of them at most."""
    ends = [[0] for _ in capacities]
    for _ in range(shards):
        bounds = [e[-1] + c for e, c in zip(ends, capacities, strict=True)]
        asked = [F.max(F.when(F.col("end") <= b, F.col("end"))).alias(f"e{k}") for k, b in enumerate(bounds)]
        # a group that ends in reach of a bound starts before it: older parts of the table are skipped by their statistics
        got = groups.where(F.col("end").between(min(e[-1] for e in ends), max(bounds))).agg(*asked).first()
        for k, e in enumerate(ends):
            e.append(max(e[-1], got[f"e{k}"] or 0))
        if all(e[-1] >= total for e in ends):
            break
    return [e[1:] for e in ends]


def smallest_capacity(groups: DataFrame, shards: int, probes: int = PROBES) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the ends of the shards at it."""
    total, largest = groups.agg(F.max("end"), F.max("size")).first()
    if total is None:
        return 0, []
    low = max(largest, -(-total // shards))  # no smaller capacity can do
    high = low + largest  # greedy shards then hold over total/shards each, unless they reach the end
    best: list[int] | None = None
    while best is None or low < high:
        step = max(1, -(-(high - low + 1) // (probes + 1)))
        tried = sorted({min(high, low + step * k) for k in range(probes + 1)} | {low, high})
        found = _greedy(groups, tried, shards, total)
        works = [k for k, ends in enumerate(found) if ends[-1] >= total]
        k = works[0]
        high, best = tried[k], found[k]
        low = tried[k - 1] + 1 if k else high
    return high, best


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot (position in its shard), grown_shard (null)."""
    rows = _ordered(docs, id_col, text_col, parts)
    groups = _groups(rows)
    _, ends = smallest_capacity(groups, shards)
    base = small(_running(rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "rows", "base"))
    placed = rows.join(base, "part").withColumn("position", F.col("base") + F.col("at"))
    # the first row of each shard after the first: shards - 1 values
    cuts = [e for e in sorted(set(ends[:-1])) if e < (ends[-1] if ends else 0)]
    starts = [0]
    if cuts:
        firsts = groups.where(F.col("begin").isin(cuts)).join(base, "part").select((F.col("base") + F.col("at")).alias("p"))
        starts += sorted(r["p"] for r in firsts.collect())
    shard = sum((F.when(F.col("position") >= p, 1).otherwise(0) for p in starts[1:]), F.lit(0))
    start = F.lit(0).cast("bigint")
    for p in starts[1:]:
        start = F.when(F.col("position") >= p, F.lit(p).cast("bigint")).otherwise(start)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"), (F.col("position") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
