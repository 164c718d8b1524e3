"""Repeated byte strings across documents, by longest-previous-factor arrays.

A window is a string of ``length`` bytes.  Removed are the bytes of windows that start anywhere
else too (``keep_first=False``), or only of later copies (``keep_first=True``: a window's first
place, by document id and position, stays).  Matches never cross documents.

1. Every window picks an anchor: of its strings of ``GRAM`` bytes the one with the smallest hash
   (the leftmost of equals).  Equal windows pick equal anchors at equal distances, so two equal
   windows always meet at their anchor's hash.  Neighbouring windows with one anchor form a run.
2. Anchors that occur once hold no repeat and are dropped; runs of equal content are counted
   as one (their windows all repeat).  That pre-aggregation is what large groups of copies cost.
3. What remains are distinct runs that share an anchor.  Their texts are laid together in blocks
   of whole anchor groups.  A suffix order of each block (by prefix doubling, as far as the
   window length) gives the common prefix of neighbours; from it each window's previous factor follows:
   the longer of its common prefixes with the previous and the next smaller position in suffix order.
   Where the factor reaches the window length, that position is an earlier match.
4. Anchors with over ``HOT`` distinct runs are first split into parts that hold the windows with the anchor at
   some distances from their start: equal windows are in one part, and windows that differ in what a part's windows
   share aren't.  Parts are halved until ``HOT`` runs at most share that; then factors decide as above.

Runs of equal content are told by 128 bits over their bytes.  Null text counts as empty.  Rows with a null id or
one that repeats are told apart by 128 bits over their text; equal rows are copies of each other.  Null ids are
kept, and first in order.  Other columns are left out; an empty table gives an empty result.  Documents shorter than
a window lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import join_counted, ready, small, tidy, written

LENGTH, GRAM = 200, 64
#: Distinct runs of one anchor that are compared in one task.
HOT = 2048
#: Bytes hashed, and bytes whose suffixes are ordered, at a time.
PIECE, BLOCK = 1 << 20, 1 << 18
_U = np.uint64
_SPOT = 21  # bits for a position in a piece
with np.errstate(over="ignore"):
    _VALUE = shingles.mix64((np.arange(256, dtype=_U) + _U(11)) * _U(0x9E3779B97F4A7C15))
    _OTHER = shingles.mix64((np.arange(256, dtype=_U) + _U(1009)) * _U(0xC2B2AE3D27D4EB4F))
RUN = "doc_id bigint, th binary, h bigint, seg bigint, seg2 bigint, lo bigint, n int, rel int"


def pieces(offsets: np.ndarray, length: int, limit: int = PIECE) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, begin, end) of ``limit`` bytes or so; long documents in overlapping parts."""
    group: list[tuple[int, int, int]] = []
    size = 0
    for doc in range(len(offsets) - 1):
        first, last = int(offsets[doc]), int(offsets[doc + 1])
        for begin in range(first, last - length + 1, limit):
            end = min(begin + limit + length - 1, last)
            if size + end - begin > limit and group:
                yield group
                group, size = [], 0
            group.append((doc, begin, end))
            size += end - begin
    if group:
        yield group


def runs_of(text: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Piece, first window, windows, distance of the anchor from the first window, anchor hash, two content hashes of each run."""
    power, inverse = shingles._powers(max(len(text) + 1, 1 << _SPOT))
    total = np.zeros(len(text) + 1, dtype=_U)
    np.cumsum(_VALUE[text] * power[: len(text)], out=total[1:])
    hashed = shingles.mix64((total[gram:] - total[:-gram]) * inverse[: len(text) - gram + 1])
    least = (hashed & ~_U((1 << _SPOT) - 1)) | np.arange(len(hashed), dtype=_U)
    n, width, span = len(text) - length + 1, length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span: width - span + n])
    anchor = (least & _U((1 << _SPOT) - 1)).astype(np.int64)
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(piece[:n] == piece[length - 1:])
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none, none
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]))))
    lo, count, spot = at[new], np.diff(np.append(new, len(at))), anchor[new]
    end = lo + count - 1 + length
    shape = ((spot - lo) * 1024 + count).astype(_U) * _U(0xD6E8FEB86659FD93)
    content = [shingles.mix64((total[end] - total[lo]) * inverse[lo] + shape).view(np.int64)]
    np.cumsum(_OTHER[text] * power[: len(text)], out=total[1:])  # an independent value for each byte
    content.append(shingles.mix64((total[end] - total[lo]) * inverse[lo] + shape).view(np.int64))
    return piece[lo], lo - bounds[piece[lo]], count, spot - lo, hashed[spot].view(np.int64), *content


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column("text"))
            for group in pieces(offsets, length):
                bounds = np.concatenate(([0], np.cumsum([e - b for _, b, e in group])))
                piece, lo, n, rel, h, seg, seg2 = runs_of(np.concatenate([raw[b:e] for _, b, e in group]), bounds, length, gram)
                doc = np.array([g[0] for g in group])[piece]
                shift = np.array([b - int(offsets[d]) for d, b, _ in group])[piece]
                at = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(h, pa.int64()), pa.array(seg, pa.int64()),
                                                  pa.array(seg2, pa.int64()), pa.array(lo + shift, pa.int64()), pa.array(n, pa.int32()), pa.array(rel, pa.int32())], names=["doc_id", "th", "h", "seg", "seg2", "lo", "n", "rel"])

    return rows.mapInArrow(tidy(run), RUN)


def suffix_order(symbols: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their strings of ``length`` symbols (equal ones by position), and the
    length of the prefix that each of them, in that order, shares with the one before.

    Prefix doubling over all positions; ``ends``: where the segment of each position ends (strings
    don't reach beyond it)."""
    n, reach = len(symbols), 7
    key = np.zeros(n, dtype=np.int64)
    at = np.arange(n)
    for j in range(reach):  # 7 symbols of 9 bits
        key = key * 512 + np.where(at + j < ends, symbols[np.minimum(at + j, n - 1)] + 1, 0)
    ranks = [np.unique(key, return_inverse=True)[1].astype(np.int64) + 1]
    while reach * 2 <= length:
        after = np.where(at + reach < ends, ranks[-1][np.minimum(at + reach, n - 1)], 0)
        ranks.append(np.unique(ranks[-1] * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1)
        reach *= 2
    key = ranks[-1][starts] * (n + 2) + ranks[-1][starts + length - reach]  # two overlapping strings cover the length
    order = np.argsort(key, kind="stable")  # starts ascend, so equal strings stay by position
    shared = np.zeros(len(order), dtype=np.int64)
    a, b = starts[order[:-1]], starts[order[1:]]
    same = shared[1:]
    for rank in reversed(ranks):  # each doubling step is used once at most
        more = rank[np.minimum(a + same, n - 1)] == rank[np.minimum(b + same, n - 1)]
        same[more & (same < length)] += reach
        reach //= 2
    for _ in range(6):
        more = (same < length) & (symbols[np.minimum(a + same, n - 1)] == symbols[np.minimum(b + same, n - 1)])
        same[more] += 1
    return order, np.minimum(shared, length)


def nearest_smaller(place: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest one before it with a smaller place (-1: none), and the prefix they share.

    All entries look at once: whoever still points at a larger place goes on to where that one points, as
    all between are larger still."""
    at = np.arange(len(place)) - 1
    common = shared.copy()
    open_ = np.flatnonzero((at >= 0) & (place[at] > place))
    while len(open_):
        over = at[open_]
        common[open_] = np.minimum(common[open_], common[over])
        at[open_] = at[over]
        open_ = open_[at[open_] >= 0]
        open_ = open_[place[at[open_]] > place[open_]]
    common[at < 0] = 0
    return at, common


def previous_factors(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the segments, in order: its segment, its start there, the length of its previous
    factor (the longest prefix that starts earlier too; ``length`` at most) and the number of the window
    where that starts (-1: none).

    Among the entries of the suffix order, the nearest ones before and after with a smaller position share the
    longest prefixes with a window."""
    sizes = np.array([len(s) for s in segments])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    symbols = np.frombuffer(b"".join(segments), dtype=np.uint8).astype(np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(segments)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, shared = suffix_order(symbols, np.repeat(bounds[1:], sizes), bounds[owner] + inside, length)
    before, left = nearest_smaller(order, shared)
    after, right = nearest_smaller(order[::-1], np.concatenate(([0], shared[:0:-1])))
    after, right = np.where(after[::-1] >= 0, len(order) - 1 - after[::-1], -1), right[::-1]
    factor, source = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    best = np.where(left >= right, before, after)
    factor[order] = np.maximum(left, right)
    source[order] = np.where((best >= 0) & (np.maximum(left, right) > 0), order[best], -1)
    return owner, inside, factor, source


_SPANS = "doc_id bigint, th binary, lo bigint, n int"


def _compared(segments: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Runs of windows that repeat, by previous (and next) factors within blocks of anchor groups."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or b"", r[3]))  # by document and position
        owner, inside, factor, source = previous_factors([r[5] for r in rows], length)
        repeats = factor >= length
        if not keep_first:
            repeats[source[repeats]] = True  # equal windows are sources of one another, in order
        hit = np.flatnonzero(repeats)
        owner, inside = owner[hit], inside[hit]
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)))) if len(hit) else hit
        count = np.diff(np.append(new, len(hit)))
        found = [(rows[o], int(i), int(c)) for o, i, c in zip(owner[new], inside[new], count, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r, _, _ in found], pa.int64()), pa.array([r[2] for r, _, _ in found], pa.binary()),
                                           pa.array([r[3] + i for r, i, _ in found], pa.int64()), pa.array([c for _, _, c in found], pa.int32())], names=["doc_id", "th", "lo", "n"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in parts:
            for row in zip(*[batch.column(c).to_pylist() for c in ("h", "doc_id", "th", "lo", "n", "bytes")], strict=True):
                if row[0] != last and size >= BLOCK:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[5]), row[0]
        if rows:
            yield block(rows)

    dealt = segments.select("h", "doc_id", "th", "lo", "n", "bytes").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(tidy(run), _SPANS)


def _split(segments: DataFrame, length: int, gram: int, keep_first: bool) -> DataFrame:
    """The same for hot anchors, in parts.

    A part holds the windows whose anchor is ``a`` to ``a + size - 1`` bytes from their start, as far as the
    run has them.  Parts of equal content repeat as a whole, and one of them goes on.  Equal windows share what all
    windows of their parts hold (the core): parts whose core is unique hold no other repeat, parts that share it with
    ``HOT`` others at most are compared by factors, the rest are halved, down to single windows."""
    size = 1 << (length - gram).bit_length()
    now = segments.select("h", "doc_id", "th", "lo", "n", "rel", "bytes", F.lit(0).alias("a"))
    found = None
    while size >= 1:
        # windows with anchors at a .. a+size-1 start at lo + rel - (a+size-1) .. lo + rel - a
        first = F.greatest(F.col("rel") - F.col("a") - (size - 1), F.lit(0))
        last = F.least(F.col("rel") - F.col("a"), F.col("n") - 1)
        part = now.withColumn("first", first).withColumn("last", last).where(F.col("first") <= F.col("last"))
        whole = F.expr(f"md5(concat(substring(bytes, first + 1, last - first + {length}), encode(concat_ws(',', first - rel, last - rel), 'UTF-8')))")
        core = F.expr(f"md5(substring(bytes, rel - a + 1, {length - size + 1}))")
        part = written(part.withColumn("whole", whole).withColumn("core", core), "hot-parts")
        place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("th"), (F.col("lo") + F.col("first")).alias("at"))
        # one part of each content goes on, as what shorter parts of others may equal
        one = F.min(F.struct(place.alias("least"), *[c for c in part.columns if c not in ("h", "a", "whole")])).alias("one")
        wholes = part.groupBy("h", "a", "whole").agg(F.count(F.lit(1)).alias("c"), one)
        wholes = written(wholes.select("h", "a", "whole", "c", "one.*"), "hot-wholes")
        total = part.count()
        full = join_counted(part, wholes.where(F.col("c") > 1).select("h", "a", "whole", "least", "c"), ["h", "a", "whole"], "c", total)
        if keep_first:  # only single windows tell which place is the first of all
            full = full.where((place != F.col("least")) & F.lit(size == 1))
        spans = full.select("doc_id", "th", (F.col("lo") + F.col("first")).alias("lo"), (F.col("last") - F.col("first") + 1).cast("int").alias("n"))
        found = spans if found is None else found.unionByName(spans)
        if size > 1:
            left = part if keep_first else wholes
            left = left.select("h", "doc_id", "th", "lo", "n", "rel", "bytes", "first", "last", "a", "core")
            cores = written(left.groupBy("h", "a", "core").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1), "hot-cores")
            left = join_counted(left, cores.withColumn("shared", F.col("c")), ["h", "a", "core"], "c", total)
            cut = left.where(F.col("shared") <= HOT).select(
                F.xxhash64("h", "a", "core").alias("h"), "doc_id", "th", (F.col("lo") + F.col("first")).alias("lo"), F.expr(f"substring(bytes, first + 1, last - first + {length})").alias("bytes"))
            found = found.unionByName(_compared(cut.withColumn("n", F.lit(0)), length, keep_first))
            now = left.where(F.col("shared") > HOT).select("h", "doc_id", "th", "lo", "n", "rel", "bytes", F.explode(F.array(F.col("a"), F.col("a") + size // 2)).alias("a"))
            now = written(now, "hot-halves")
            if now.isEmpty():
                break
        size //= 2
    return found


def _spans(rows: DataFrame, length: int, gram: int, keep_first: bool) -> DataFrame:
    """(doc_id, th, spans) of the rows that repeat something: byte ranges to remove, as ascending
    [from, to, from, to ...], merged; ``th`` tells rows of a null or repeated id apart (see ``_keyed``)."""
    runs = _runs(rows, length, gram)
    shared = runs.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("h")
    shared = written(shared, "anchors")
    kept = written(runs.join(shared, "h"), "runs")
    place = F.struct("doc_id", "th", "lo")
    distinct = written(kept.groupBy("h", "seg", "seg2").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("least"), F.first("n").alias("n"), F.first("rel").alias("rel")), "distinct-runs")
    copies = join_counted(kept, distinct.where(F.col("c") > 1).select("h", "seg", "seg2", "least", "c"), ["h", "seg", "seg2"], "c", kept.count())
    if keep_first:
        copies = copies.where(place != F.col("least"))
    spans = copies.select("doc_id", "th", "lo", "n")
    # anchors with several distinct runs, at least one of them still undecided
    groups = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.min("c").alias("c1")).where((F.col("d") > 1) & ((F.col("c1") == 1) | F.lit(keep_first))).select("h", "d")
    asked = distinct.join(groups, "h").select("h", "d", "least.*", "n", "rel")
    segments = written(_cut(rows, asked, length), "segments")
    spans = spans.unionByName(_compared(segments.where(F.col("d") <= HOT), length, keep_first))
    hot = segments.where(F.col("d") > HOT)
    if not hot.isEmpty():
        spans = spans.unionByName(_split(hot, length, gram, keep_first))
    # bounded by the length of a document
    lists = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "n")).alias("found"))

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            merged = []
            for found in batch.column("found").to_pylist():
                out: list[int] = []
                for lo, hi in sorted((x["lo"], x["lo"] + x["n"] - 1 + length) for x in found):
                    if out and lo <= out[-1]:
                        out[-1] = max(out[-1], hi)
                    else:
                        out += [lo, hi]
                merged.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(merged, pa.list_(pa.int64()))], names=["doc_id", "th", "spans"])

    return written(lists.mapInArrow(tidy(merge), "doc_id bigint, th binary, spans array<bigint>"), "spans")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text): ``th`` is null for an id that occurs once, else 128 bits over the text."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    ids = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    repeated = written(ids.where(F.col("c") > 1).select("doc_id", F.lit(True).alias("twice")), "repeated-ids")
    marked = rows.join(small(repeated), "doc_id", "left")
    return marked.select("doc_id", F.when(F.col("doc_id").isNull() | F.col("twice"), F.unhex(F.md5("text"))).alias("th"), "text")


def _cut(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the asked runs: (h, d, doc_id, th, lo, n, rel, bytes)."""
    lists = written(asked.groupBy(F.col("doc_id").alias("i"), F.col("th").alias("t")).agg(F.collect_list(F.struct("h", "d", "lo", "n", "rel")).alias("asked")), "asked")
    joined = rows.join(lists.hint("merge"), rows["doc_id"].eqNullSafe(F.col("i")) & rows["th"].eqNullSafe(F.col("t"))).select("doc_id", "th", "text", "asked")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column("text"))
            found: list[tuple] = []
            for k, asked in enumerate(batch.column("asked").to_pylist()):
                first = int(offsets[k])
                found += [(k, x["h"], x["d"], x["lo"], x["n"], x["rel"], raw[first + x["lo"]: first + x["lo"] + x["n"] - 1 + length].tobytes()) for x in asked]
            at = pa.array([f[0] for f in found], pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("th").take(at), *[pa.array([f[j + 1] for f in found], kind) for j, kind in enumerate(kinds)]],
                                             names=["doc_id", "th", "h", "d", "lo", "n", "rel", "bytes"])

    return joined.mapInArrow(tidy(run), "doc_id bigint, th binary, h bigint, d bigint, lo bigint, n int, rel int, bytes binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    ready(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    spans = _spans(rows, length, gram, keep_first).select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "spans")
    joined = rows.join(spans.hint("merge"), rows["doc_id"].eqNullSafe(F.col("i")) & rows["th"].eqNullSafe(F.col("t")), "left").select("doc_id", "text", "spans")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = []
            for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                spans = spans or []
                edges = [0, *spans, len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
