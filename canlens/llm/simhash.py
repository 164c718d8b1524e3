"""SimHash near-duplicates by pigeonring filtering.

Fingerprint.  Every word shingle of the whole text, repeats included, votes with its 64-bit hash
(XXH64, seed 42); a bit is set where over half the hashes have it.  Texts with fewer words vote
once with their whole sequence; texts without words have fingerprint zero and are linked like any
other.  Words are read a slice of a text at a time, so memory doesn't grow with a text.

Filter.  Fingerprints are rings of ``SEGMENTS`` segments.  If two differ in ``DISTANCE`` bits at
most, some start has a chain that is *viable*: the differences of its first l segments sum to
l * DISTANCE / SEGMENTS at most, for every l.  As such a chain starts with equal segments often
enough, the places of its first ``EQUAL`` equal segments are among a few patterns; each start and
pattern is a table whose key is those segments (24 bits).  Fingerprints that share a key are
pruned by the chain from that start, and what is left by the full distance.

Groups.  Only distinct fingerprints are keyed, so copies cost nothing here.  Within a key, links are
searched breadth first among those not reached yet, which gives a spanning forest of the links,
never all pairs.  Keys with over ``BLOCK`` fingerprints are dealt to pairs of blocks, every pair of
fingerprints in one of them, so no task holds more than two blocks.

Rows.  Null texts are empty.  A row with a null id gets a fingerprint and links others through it;
its component is the smallest id reachable, null if there is none.  Repeated ids and rows are kept as
they are; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, ready, small, tidy, written
from .components import components
from .wordlists import SPACE, raw_text, slices

WIDTH, SEED = 4, 42
SEGMENTS, DISTANCE, EQUAL = 8, 4, 3
#: Fingerprints of a key that one task compares with as many others, at most.
BLOCK = 2048
#: Runs up to this many fingerprints are compared by shifts of the whole batch.
SHORT = 16
_U = np.uint64
_BITS = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)
#: What the first l segments of a viable chain may differ by, for l = 1 to SEGMENTS.
BUDGETS = np.array([n * DISTANCE // SEGMENTS for n in range(1, SEGMENTS + 1)], dtype=np.uint8)


def shingle_hashes(raw: bytes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, in order, slice by slice."""
    kept: list[bytes] = []
    found = False
    for part in slices(raw, SPACE):
        words = kept + part.lower().split()
        if len(words) < width:
            kept = words
            continue
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=_U)
        found, kept = True, words[len(words) - width + 1:]
    if kept and not found:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], dtype=_U)


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    votes, n = np.zeros(64, dtype=np.int64), 0
    for hashed in shingle_hashes(raw, width):
        bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(hashed)
    return int(np.packbits(2 * votes > n, bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed 64-bit integer."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = np.array([fingerprint(raw_text(t.as_py()), width) for t in batch.column("text")], dtype=_U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64), pa.int64())], names=["doc_id", "print"])

    return docs.mapInArrow(tidy(run), "doc_id bigint, print bigint")


def patterns(equal: int = EQUAL) -> list[tuple[int, ...]]:
    """Places of the first ``equal`` equal segments in a viable chain: every place before the last
    that isn't one of them differs by a bit or more, and their number must stay within the budgets."""
    found = []

    def extend(places: tuple[int, ...], at: int, differing: int) -> None:
        if len(places) == equal:
            found.append(places)
        elif at < SEGMENTS and differing <= BUDGETS[at]:
            extend((*places, at), at + 1, differing)
            if differing + 1 <= BUDGETS[at]:
                extend(places, at + 1, differing + 1)

    extend((), 0, 0)
    return found


PATTERNS = patterns()


def _key(number: int, start: int, places: tuple[int, ...]) -> Column:
    """The number of a table and the segments at ``places`` of the chain from ``start``."""
    key = F.lit(number).cast("bigint")
    for place in places:
        at = 8 * ((start + place) % SEGMENTS)
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("print", at).bitwiseAND(F.lit(255).cast("bigint")))
    return key


def chain_keys(prints: DataFrame) -> DataFrame:
    """(key, print): one row for each start and pattern; the key holds the start."""
    keys = [_key(start * len(PATTERNS) + k, start, places) for start in range(SEGMENTS) for k, places in enumerate(PATTERNS)]
    return prints.select("print", F.explode(F.array(*keys)).alias("key"))


def start_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.int64(8 * EQUAL)) // len(PATTERNS)


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the pairs are links with a viable chain from their start.

    The chain is summed as far as a key's places reach; pairs it prunes have no full distance taken."""
    apart = _BITS[(a ^ b).view(np.uint8).reshape(-1, 8)]
    reach = max(places[-1] for places in PATTERNS) + 1
    sums, good = np.zeros(len(apart), dtype=np.uint8), np.ones(len(apart), dtype=bool)
    row = np.arange(len(apart))
    for n in range(reach):
        sums = sums + apart[row, (start + n) % SEGMENTS]
        good &= sums <= BUDGETS[n]
    at = np.flatnonzero(good)
    good[at] = apart[at].sum(axis=1) <= DISTANCE
    return good


def spanning_links(prints: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the groups among ``prints``: breadth first, against those not reached yet."""
    left = prints
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            one = queue.pop()
            while len(one) and len(left):
                x, one = one[:1], one[1:]
                good = linked(np.repeat(x, len(left)), left, np.full(len(left), start))
                if good.any():
                    yield np.repeat(x, int(good.sum())), left[good]
                    queue.append(left[good])
                    left = left[~good]


def _run_links(key: np.ndarray, prints: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within the runs that ``bounds`` cut."""
    sizes = np.diff(bounds)
    run = np.repeat(np.arange(len(sizes)), sizes)
    short = np.flatnonzero((sizes[run] <= SHORT) & (sizes[run] > 1))
    step = 1
    while len(short := short[short + step < bounds[run[short] + 1]]):
        good = linked(prints[short], prints[short + step], start_of(key[short]))
        yield prints[short[good]], prints[short[good] + step]
        step += 1
    for k in np.flatnonzero(sizes > SHORT):
        yield from spanning_links(np.unique(prints[bounds[k]: bounds[k + 1]]), int(start_of(key[bounds[k]: bounds[k] + 1])[0]))


def _search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the runs of equal (key, i, j) in sorted rows; a run may go on in the next batch."""
    empty = [np.zeros(0, dtype=np.int64) for _ in range(4)]
    held = empty
    for batch in parts:
        rows = [np.concatenate((h, batch.column(c).to_numpy(zero_copy_only=False))) for h, c in zip(held, ("key", "i", "j", "print"), strict=True)]
        new = np.flatnonzero(np.any([r[1:] != r[:-1] for r in rows[:3]], axis=0)) + 1
        cut = int(new[-1]) if len(new) else 0
        held = [r[cut:] for r in rows]
        yield from _as_batches(rows[0][:cut], rows[3][:cut], np.concatenate(([0], new)) if cut else np.zeros(1, dtype=np.int64))
    yield from _as_batches(held[0], held[3], np.array([0, len(held[0])] if len(held[0]) else [0]))


def _as_batches(key: np.ndarray, prints: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for x, y in _run_links(key, prints.view(_U), bounds):
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["x", "y"])


def links(prints: DataFrame) -> DataFrame:
    """(x, y): links that span the groups of the distinct fingerprints ``print``."""
    keyed = chain_keys(prints)
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK)
    crowded = written(crowded.select("key", F.ceil(F.col("members") / BLOCK).cast("bigint").alias("blocks")), "simhash-crowded")
    dealt = keyed.join(small(crowded), "key", "left")
    own = F.pmod(F.xxhash64("print"), F.col("blocks"))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("blocks") - 1), lambda d: F.struct(
            F.least(F.col("own"), F.pmod(F.col("own") + d, F.col("blocks"))).alias("i"), F.greatest(F.col("own"), F.pmod(F.col("own") + d, F.col("blocks"))).alias("j"))))
    dealt = dealt.withColumn("own", own).select("key", "print", F.inline(pairs))
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(ordered.mapInArrow(tidy(_search), "x bigint, y bigint").distinct(), "simhash-links")


def near_duplicates(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, fingerprint (hex), component_id (smallest id reachable)."""
    ready(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    rows = written(fingerprints(texts, width), "simhash-prints")
    distinct = written(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")), "simhash-distinct")
    found = written(components(links(distinct.select("print")), "x", "y"), "simhash-components")
    rooted = distinct.join(found, distinct["print"] == found["node"], "left").select("print", "least", "members", F.coalesce("component", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(rooted.join(least, "root").select("print", "members", "component_id"), "simhash-known")
    out = join_counted(rows, known, ["print"], "members", rows.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
