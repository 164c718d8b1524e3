"""Benchmark decontamination by spaced-seed hashing.

A mask covers a span of words and ignores some of them: words may differ there.  The masks are
chosen so that for any substituted words that a span may have, at least one mask ignores them all:
``ERRORS`` in ``SPAN`` words for the usual overlap, else what ``seed`` derives from the length of the
stretch and the similarity, so that no stretch that passes verification goes without a joined hash.
Each position of a benchmark item and of a document is hashed under each mask; equal hashes
join a document and an item on a diagonal (their relative position).  Every such diagonal is
then verified on the words themselves: a stretch of ``overlap`` words (or the whole item if
it is shorter) in which ``similarity`` of the words agree is an overlap.

Benchmark hashes are hashed once more into a bit map of fixed size, which the document pass uses
to leave out positions that can't join (a full map only lets more through); the join itself
is an equi-join of tables.  Only documents with a joined hash are read again for verification.

Words: runs of letters and digits and of anything beyond ASCII, lower-cased A-Z.  Items of
fewer than ``SPAN`` words have masks of their length; items without words match nothing.  Null texts hold no words; null ids are kept,
and rows with one are told apart by a hash of their text (equal texts share a result); rows that
repeat an id share a result; other columns are left out; an empty table on either side contaminates
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import ready, small, small_bytes, small_lists, tidy, written

SPAN, IGNORED, ERRORS = 12, 5, 2
#: Bits of the map of benchmark hashes (a fixed bound on what is broadcast: 2 MB).
MAP_BITS = 24
_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)


def masks(span: int = SPAN, ignored: int = IGNORED, errors: int = ERRORS) -> list[tuple[int, ...]]:
    """Kept positions of each mask: greedily, the mask that ignores most error patterns left.

    The first and the last word are errors that may be ignored like any other."""
    left = set(combinations(range(span), errors))
    found = []
    while left:
        best = max(combinations(range(span), ignored), key=lambda m: len(left & set(combinations(m, errors))))
        left -= set(combinations(best, errors))
        found.append(tuple(i for i in range(span) if i not in best))
    return found


MASKS = masks()


def errors_allowed(length: int, similarity: float) -> int:
    """Words of a stretch that may differ, by the comparison that verifies it."""
    return max(e for e in range(length) if length - e >= similarity * length)


def seed(length: int, similarity: float) -> tuple[int, int]:
    """Span and errors of the masks for stretches of ``length`` words.

    A stretch of n spans side by side has one with a n-th of its errors at most."""
    n = max(1, length // SPAN)
    span, errors = length // n, errors_allowed(length, similarity) // n
    return (SPAN, ERRORS) if span >= SPAN and errors <= ERRORS else (span, errors)


@cache
def masks_for(span: int, errors: int) -> list[tuple[int, ...]]:
    """Kept positions of masks that ignore any ``errors`` words of a span: ``MASKS`` or as few; for
    more than ``ERRORS`` the span is cut into pieces, and each mask keeps two pieces."""
    if (span, errors) == (SPAN, ERRORS):
        return MASKS
    if span <= SPAN and errors <= ERRORS:
        return next(m for ignored in range(errors, span) if len(m := masks(span, ignored, errors)) <= len(MASKS) or ignored == span - 1)
    kept = min(2, span - errors)
    pieces = np.array_split(np.arange(span), errors + kept)
    return [tuple(int(i) for piece in chosen for i in piece) for chosen in combinations(pieces, kept)]


def spaced_hashes(words: np.ndarray, doc: np.ndarray, span: int = SPAN, errors: int = ERRORS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask, positions in ``words``, hashes) of all full spans within one document each."""
    n = len(words) - span + 1
    if n <= 0:
        return
    at = np.flatnonzero(doc[:n] == doc[span - 1:])
    # masks of another span or error count start from other values
    start = 1 if (span, errors) == (SPAN, ERRORS) else span << 32 | errors << 16
    for number, kept in enumerate(masks_for(span, errors)):
        acc = np.full(n, start + number, dtype=_U)
        for j in kept:
            np.multiply(acc, _FACTOR, out=acc)
            np.add(acc, words[j: j + n], out=acc)
        acc = acc[at]
        acc ^= acc >> _U(32)
        yield number, at, acc * _FACTOR


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - MAP_BITS)).astype(np.int64)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _item_hashes(items: DataFrame, overlap: int, similarity: float) -> DataFrame:
    """(hash, item_id, at, n_words) of all spans of all items, and each item's words."""

    def hash_items(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column("text"))
            ids = batch.column("item_id").to_pylist()
            rows: list[tuple] = []
            for lo, hi in shingles.blocks(offsets):
                words, _, _, doc = shingles.word_hashes(raw, offsets[lo: hi + 1], shingles.ALNUM)
                counts = np.bincount(doc, minlength=hi - lo)
                first = np.concatenate(([0], np.cumsum(counts)))
                need = np.minimum(counts, overlap)
                seeds = {int(n): seed(int(n), similarity) for n in np.unique(need[need > 0])}
                found = ((s, *f) for s in sorted(set(seeds.values())) for f in spaced_hashes(words, doc, *s))
                for s, _, at, hashed in found:
                    own = np.isin(need[doc[at]], [n for n in seeds if seeds[n] == s])
                    at, hashed = at[own], hashed[own]
                    owner = doc[at]
                    rows.extend(zip(_signed(hashed).tolist(), [ids[lo + k] for k in owner.tolist()], (at - first[owner]).tolist(), counts[owner].tolist(), strict=True))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array([int(x) if x is not None else None for x in c], pa.int64()) for c in columns], names=["hash", "item_id", "at", "n_words"])

    return items.mapInArrow(tidy(hash_items), "hash bigint, item_id bigint, at bigint, n_words bigint")


def _own_key(text):
    """Tells rows with a null id apart; null for rows with an id."""
    return F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce(text, F.lit("")), 256)).alias("own_key")


def _same_document(left: DataFrame, doc_id: str, own_key: str):
    return left["doc_id"].eqNullSafe(F.col(doc_id)) & left["own_key"].eqNullSafe(F.col(own_key))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, first_word (in the
    document, of the best stretch), n_words (its length), n_equal (words that agree)."""
    return _overlaps(docs, benchmark, overlap, similarity, id_col, text_col, item_col, item_text_col).drop("own_key")


def _overlaps(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``find_overlaps`` with ``own_key``, which tells rows with a null id apart."""
    if overlap < 1 or not 0 < similarity <= 1:
        raise ValueError(f"no masks for an overlap of {overlap} words and a similarity of {similarity}: at least 1 word, and over 0 to 1")
    spark = ready(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.select("doc_id", _own_key(F.col("text")), "text")
    items = benchmark.select(benchmark[item_col].cast("bigint").alias("item_id"), benchmark[item_text_col].alias("text"))
    hashes = written(_item_hashes(items, overlap, similarity), "item-hashes")
    # a map of fixed size: its set bits, by words of 64
    bit = f"shiftrightunsigned(hash, {64 - MAP_BITS})"
    set_bits = hashes.selectExpr(f"shiftright({bit}, 6) AS word", f"shiftleft(1L, CAST({bit} & 63 AS INT)) AS b")
    words64 = set_bits.groupBy("word").agg(F.bit_or("b").alias("bits")).collect()
    packed = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    for r in words64:
        packed[r["word"]] = r["bits"]
    bits = spark.sparkContext.broadcast(packed.tobytes())
    # lengths of the items' stretches: ``overlap`` values at most
    lengths = hashes.select(F.least("n_words", F.lit(overlap)).alias("n")).distinct().collect()
    seeds = sorted({seed(r["n"], similarity) for r in lengths})

    def hash_docs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8), bitorder="little").view(bool)
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column("text"))
            ids, keys = batch.column("doc_id"), batch.column("own_key")
            for lo, hi in shingles.blocks(offsets):
                words, _, _, doc = shingles.word_hashes(raw, offsets[lo: hi + 1], shingles.ALNUM)
                first = np.searchsorted(doc, np.arange(hi - lo))
                for _, at, hashed in (f for s in seeds for f in spaced_hashes(words, doc, *s)):
                    hit = table[_bit(hashed)]
                    if hit.any():
                        at, hashed = at[hit], hashed[hit]
                        row = pa.array(doc[at] + lo)
                        yield pa.RecordBatch.from_arrays([ids.take(row), keys.take(row), pa.array(_signed(hashed), pa.int64()), pa.array(at - first[doc[at]], pa.int64())], names=["doc_id", "own_key", "hash", "position"])

    hits = rows.mapInArrow(tidy(hash_docs), "doc_id bigint, own_key string, hash bigint, position bigint")
    diagonals = hits.join(small(hashes), "hash").select("doc_id", "own_key", "item_id", (F.col("position") - F.col("at")).alias("diagonal"))
    diagonals = written(diagonals.distinct(), "diagonals")
    asked = diagonals.groupBy("doc_id", "own_key", "item_id").agg(F.collect_set("diagonal").alias("diagonals"))  # at most one for each word of a document
    hit = diagonals.select(F.col("doc_id").alias("d"), F.col("own_key").alias("k")).distinct()
    texts = rows.join(small(hit), _same_document(rows, "d", "k"), "left_semi")
    texts = written(texts, "texts-with-hits").withColumnsRenamed({"doc_id": "d", "own_key": "k"})
    pairs = asked.join(texts, _same_document(asked, "d", "k")).select("doc_id", "own_key", "item_id", "diagonals", "text")
    item_texts = items.select(F.col("item_id").alias("i"), F.col("text").alias("item_text"))
    pairs = pairs.join(small_bytes(item_texts, "item_text"), F.col("item_id").eqNullSafe(F.col("i"))).drop("i")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            good: list[tuple] = []
            columns = [batch.column(c) for c in ("text", "item_text")]
            for k, asked in enumerate(batch.column("diagonals").to_pylist()):
                text, item = (shingles.word_hashes(*shingles.utf8_column(c.slice(k, 1)), shingles.ALNUM)[0] for c in columns)
                best = max((best_stretch(text, item, d, overlap) for d in asked), key=lambda x: (x[2], -x[0]))
                if best[1] and best[2] >= similarity * best[1]:
                    good.append((k, *best))
            at = pa.array([g[0] for g in good], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("doc_id", "own_key", "item_id")], *[pa.array([g[j] for g in good], pa.int64()) for j in (1, 2, 3)]], names=["doc_id", "own_key", "item_id", "first_word", "n_words", "n_equal"])

    found = pairs.mapInArrow(tidy(verify), "doc_id bigint, own_key string, item_id bigint, first_word bigint, n_words bigint, n_equal bigint")
    best = F.max(F.struct("n_equal", (-F.col("first_word")).alias("w"), "n_words")).alias("best")
    found = found.groupBy("doc_id", "own_key", "item_id").agg(best)
    return found.select("doc_id", "own_key", "item_id", (-F.col("best.w")).alias("first_word"), "best.n_words", "best.n_equal")


def best_stretch(text: np.ndarray, item: np.ndarray, diagonal: int, overlap: int) -> tuple[int, int, int]:
    """First word in the text, length and equal words of the best stretch on a diagonal.

    A stretch has ``overlap`` words, or all of an item with fewer; (0, 0, 0) if none fits."""
    need = min(overlap, len(item))
    lo, hi = max(0, diagonal), min(len(text), diagonal + len(item))
    if need == 0 or hi - lo < need:
        return 0, 0, 0
    equal = np.concatenate(([0], np.cumsum(text[lo:hi] == item[lo - diagonal: hi - diagonal])))
    sums = equal[need:] - equal[:-need]
    k = int(np.argmax(sums))
    return lo + k, need, int(sums[k])


def decontaminate(docs: DataFrame, benchmark: DataFrame, overlap: int = 13, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids (ascending), n_equal (of the best stretch)."""
    found = _overlaps(docs, benchmark, overlap, similarity, id_col, text_col)
    # at most one entry for each item
    per_doc = written(found.groupBy(F.col("doc_id").alias("d"), F.col("own_key").alias("k")).agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("n_equal").alias("n_equal")), "contaminated")
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.select("doc_id", _own_key(F.col("text")))
    joined = rows.join(small_lists(per_doc, "item_ids"), _same_document(rows, "d", "k"), "left")
    none = F.array().cast("array<bigint>")
    return joined.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"),
                         F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_equal", F.lit(0)).alias("n_equal"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id (for a null id, whose text) overlaps no benchmark item."""
    found = _overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    gone = written(found.select(F.col("doc_id").alias("_gone_id"), F.col("own_key").alias("_gone_key")).distinct(), "gone")
    own_id = docs[id_col].cast("bigint")
    own_key = F.when(own_id.isNull(), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    return docs.join(small(gone), own_id.eqNullSafe(F.col("_gone_id")) & own_key.eqNullSafe(F.col("_gone_key")), "left_anti")
