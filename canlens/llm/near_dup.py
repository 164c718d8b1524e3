"""MinHash near-duplicates by tensored banding, confirmed on full shingle sets.

Sketches.  A document is its set of distinct word shingles, hashed to 64 bits.  Two collections
of ``M`` half keys each are computed, a half key being ``K`` minhashes: 2*M*K minhashes in all.
A table's key is a pair of half keys, one from each collection: M*M tables of 2*K minhashes, for
about the square root of the minhashes that separate tables would need.  Documents at a
similarity of 0.85 share no table with a probability of 2 * (1 - 0.85**K)**M, about 3e-6.

Rows.  Documents with equal sets are one class from the start, told apart by 128 bits over the
set and its size.  A pair of half keys can be shared only if each of them is, so half keys that
occur once are dropped before the pairs are formed: most documents form none.

Links.  In each bucket the members are compared with the smallest member; links are confirmed on
the full sets of both whole texts, and their components found.  Buckets whose members are then
still in several components hold pairs that were not compared: those across components are
compared too, so that no link between components is lost:

* in buckets of ``SMALL`` members at most, pair by pair (each pair once);
* members of larger ones (hot groups) in blocks of ``BLOCK``, grouped by single minhashes, each
  pair of blocks in one task that gives back only links that connect.

Pairs are left out before that only if their sizes rule out the threshold, or fewer than
``AGREE`` of their 2*M*K minhashes agree (five standard errors under a similarity of 0.85).

Null and empty texts and texts without words have an empty set: linked with nothing.  A row with
a null id links nothing; its component is null and it is kept.  Rows that share an id are one
node: what links to one of them links to the id.  Other columns are left out.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import ready, small, tidy, without, written
from .components import components

M, K, WIDTH, PERCENT = 14, 3, 5, 85
AGREE, SMALL, BLOCK, SUPER = 0.65, 64, 512, 8
_U = np.uint64
_N = 2 * M * K


def _seeds() -> np.ndarray:
    with np.errstate(over="ignore"):
        return (shingles.mix64(np.arange(1, _N + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32) | np.uint32(1)


_SEEDS = _seeds()


def minhashes(hashed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, 2*M*K) minhashes; every document must have a shingle."""
    low, high = hashed.astype(np.uint32), (hashed >> _U(32)).astype(np.uint32)
    found = np.empty((len(offsets) - 1, _N), dtype=np.uint32)
    for k, seed in enumerate(_SEEDS):
        x = (high ^ seed) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x += low * seed
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(13)
        found[:, k] = np.minimum.reduceat(x, offsets[:-1])
    return found


def half_keys(found: np.ndarray) -> np.ndarray:
    """(documents, 2*M) 64-bit half keys: the first M belong to one collection, the rest to the other."""
    keys = np.zeros((len(found), 2 * M), dtype=_U)
    keys += np.arange(1, 2 * M + 1, dtype=_U)
    for k in range(K):
        keys = shingles.mix64(keys * _U(0x9E3779B97F4A7C15) + found[:, k::K].astype(_U))
    return keys


def _shingled(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    words, _, _, doc = shingles.word_hashes(raw, offsets)
    return shingles.shingle_hashes(words, doc, len(offsets) - 1, width)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, a, b (128 bits over the set), keys (half keys), mins (16 bits of each minhash)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column("text"))
            for lo, hi in shingles.blocks(offsets):
                hashed, bounds = _shingled(raw, offsets[lo: hi + 1], width)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                a, b = np.zeros(hi - lo, dtype=_U), np.zeros(hi - lo, dtype=_U)
                lists, mins = [None] * (hi - lo), [None] * (hi - lo)
                if len(some):
                    starts = bounds[:-1][some]
                    a[some] = np.add.reduceat(hashed, starts)
                    b[some] = np.add.reduceat(shingles.mix64(hashed ^ _U(0x5851F42D4C957F2D)), starts)
                    found = minhashes(hashed, np.append(starts, len(hashed)))
                    for k, row, m in zip(some.tolist(), half_keys(found).view(np.int64), found.astype(np.uint16).view(np.int16), strict=True):
                        lists[k], mins[k] = row, m
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                                                  pa.array(lists, pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int16()))], names=names)

    names = ["doc_id", "n", "a", "b", "keys", "mins"]
    return docs.mapInArrow(tidy(run), "doc_id bigint, n bigint, a bigint, b bigint, keys array<bigint>, mins array<smallint>")


def linked(size_a: int, size_b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (size_a + size_b - both)


def _sizes_allow(percent: int) -> Column:
    return 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (x, y) that are linked, by the full sets of both texts."""
    wanted = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    held = written(texts.join(small(wanted), texts["doc_id"] == wanted["id"]).select("id", "text"), "near-texts")
    left = held.select(F.col("id").alias("x"), F.col("text").alias("tx"))
    right = held.select(F.col("id").alias("y"), F.col("text").alias("ty"))
    both = pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            good = []
            columns = [batch.column("tx"), batch.column("ty")]
            for k in range(batch.num_rows):
                s, t = (_shingled(*shingles.utf8_column(c.slice(k, 1)), width)[0] for c in columns)
                if len(s) and len(t) and linked(len(s), len(t), len(np.intersect1d(s, t, assume_unique=True)), percent):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("x").take(pa.array(good, pa.int64())), batch.column("y").take(pa.array(good, pa.int64()))], names=["x", "y"])

    return written(both.mapInArrow(tidy(run), "x bigint, y bigint").distinct(), "near-links")


def _likely(pairs: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that their sizes and minhashes don't rule out."""
    left = alive.select(F.col("rep").alias("x"), F.col("n").alias("n1"), F.col("mins").alias("m1"))
    right = alive.select(F.col("rep").alias("y"), F.col("n").alias("n2"), F.col("mins").alias("m2"))
    agree = F.size(F.filter(F.zip_with("m1", "m2", lambda a, b: a == b), lambda same: same))
    return pairs.join(left, "x").join(right, "y").where(_sizes_allow(percent) & (agree >= int(AGREE * _N))).select("x", "y").distinct()


def _blockwise(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect components among hot members: (rep, component, mins) -> (x, y)."""
    grouped = rows.select("rep", "component", F.posexplode(F.slice("mins", 1, SUPER)).alias("t", "least"))
    sizes = grouped.groupBy("t", "least").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = grouped.join(sizes, ["t", "least"]).withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("rep", "component", "own", "t", "least", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    held = written(texts.join(small(rows.select(F.col("rep").alias("r")).distinct()), texts["doc_id"] == F.col("r")).select("doc_id", "text"), "hot-texts")
    dealt = dealt.join(held, dealt["rep"] == held["doc_id"]).select("t", "least", "i", "j", "own", "rep", "component", "text")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", kind="stable").reset_index(drop=True)
        hashed, bounds = _shingled(*shingles.utf8_column(pa.array(part["text"], pa.string())), width)
        _, code = np.unique(hashed, return_inverse=True)
        sizes, own, comp = np.diff(bounds), part["own"].to_numpy(), part["component"].to_numpy().copy()
        some = np.flatnonzero(sizes)
        mark = np.zeros(code.max(initial=0) + 1, dtype=bool)
        found = []
        for x in range(len(part)):
            mine = code[bounds[x]: bounds[x + 1]]
            if not len(mine):
                continue
            mark[mine] = True
            both = np.zeros(len(part), dtype=np.int64)
            both[some] = np.add.reduceat(mark[code].astype(np.int64), bounds[:-1][some])
            mark[mine] = False
            good = (100 * both >= percent * (sizes + sizes[x] - both)) & (sizes > 0) & (comp != comp[x])
            if key[2] != key[3]:
                good &= own != own[x]
            for y in np.flatnonzero(good):
                if comp[y] != comp[x]:  # an earlier link of this loop may have joined them
                    found.append((int(part["rep"][x]), int(part["rep"][y])))
                    comp[comp == comp[y]] = comp[x]
        return pd.DataFrame(found, columns=["x", "y"], dtype="int64")

    return written(dealt.groupBy("t", "least", "i", "j").applyInPandas(run, "x bigint, y bigint").distinct(), "hot-links")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest id reachable), kept, links tested."""
    ready(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    rows = written(_sketched(texts, width), "near-sketches")
    full = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = written(full.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("mins").alias("mins")), "near-classes")

    halves = reps.select("rep", "a", "b", F.posexplode("keys").alias("at", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("half")
    live = halves.join(shared, "half").groupBy("rep", "a", "b").agg(F.collect_list(F.when(F.col("at") < M, F.col("half"))).alias("us"), F.collect_list(F.when(F.col("at") >= M, F.col("half"))).alias("vs"))
    live = written(live.where((F.size("us") > 0) & (F.size("vs") > 0)), "near-live")
    alive = written(reps.join(live.select("a", "b"), ["a", "b"]).select("rep", "n", "mins"), "near-alive")

    table = live.select("rep", F.explode("us").alias("u"), "vs").select("rep", "u", F.explode("vs").alias("v")).select("rep", F.xxhash64("u", "v").alias("key"))
    hubs = table.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    table = written(table.join(hubs, "key"), "near-buckets")
    stars = table.where(F.col("rep") != F.col("hub")).select(F.col("rep").alias("x"), F.col("hub").alias("y")).distinct()
    links = _confirm(written(_likely(stars, alive, percent), "near-pairs"), texts, width, percent)
    # ids that several classes hold are one node
    repeated = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("doc_id")
    same = full.join(small(repeated), "doc_id").join(reps, ["a", "b", "n"]).select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
    links = written(links.unionByName(same.where(F.col("x") != F.col("y")).distinct()), "near-links")
    found = written(components(links, "x", "y"), "near-components")

    # buckets whose members are in several components
    part_of = found.select(F.col("node").alias("rep"), "component")
    table = table.join(part_of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = table.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where(F.col("c1") < F.col("c2")).select("key")
    open_rows = written(table.join(split, "key").select("key", "rep", "members", "component"), "near-open")
    hot = written(open_rows.where(F.col("members") > SMALL).select("rep", "component").distinct().join(alive.select("rep", "mins"), "rep"), "near-hot")
    marked = open_rows.where(F.col("members") <= SMALL).join(hot.select("rep", F.lit(True).alias("hot")).distinct(), "rep", "left")
    left = marked.select("key", F.col("rep").alias("x"), F.col("component").alias("cx"), F.col("hot").alias("hx"))
    right = marked.select("key", F.col("rep").alias("y"), F.col("component").alias("cy"), F.col("hot").alias("hy"))
    apart = left.join(right, "key").where((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & (F.col("hx").isNull() | F.col("hy").isNull()))
    more = _confirm(written(_likely(apart.select("x", "y").distinct(), alive, percent), "near-apart"), texts, width, percent)
    if not hot.isEmpty():
        more = more.unionByName(_blockwise(hot, texts, width, percent))
    more = written(more, "near-more")
    if not more.isEmpty():
        found = written(components(links.unionByName(more), "x", "y"), "near-components")

    classes = reps.select("a", "b", "n", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("a", "b", "n", F.coalesce("component", "rep").alias("component_id"))
    out = full.join(classes, ["a", "b", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those of a component's other documents."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    return without(docs, found.where(~F.col("kept")), id_col)
