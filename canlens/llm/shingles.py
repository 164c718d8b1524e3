"""Hashed words and word shingles of whole texts, computed on Arrow buffers in blocks.

Words are maximal runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z
only.  All hashes are 64 bit.  The work is NumPy over the UTF-8 bytes of a block of
documents (``BLOCK_BYTES`` at most, or one document), so memory is bounded by the block
or the longest document and no Python object exists per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time.
BLOCK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective): spreads every input bit over the word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_table() -> np.ndarray:
    with np.errstate(over="ignore"):
        table = mix64((np.arange(256, dtype=_U) + _U(1)) * _U(_BASE))
    upper = np.arange(65, 91)
    table[upper] = table[upper + 32]
    return table


_VALUE = _byte_table()
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes for which punctuation separates too: ASCII letters and digits, and all of UTF-8 beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: As ``ALNUM`` without digits.
LETTERS = ALNUM.copy()
LETTERS[48:58] = False
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS["p"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("p", _BASE), ("i", inverse)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["p"], _POWERS["i"]


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents holding ``limit`` bytes at most, or a single document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_hashes(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte, end byte and document number of each word of the block.

    ``kind`` tells which bytes belong to words."""
    start, end = int(offsets[0]), int(offsets[-1])
    text = raw[start:end]
    is_word = kind[text]
    first = np.zeros(len(text) + 1, dtype=bool)
    bounds = offsets - start
    first[bounds] = True  # a document begins here, or the block ends
    before = np.empty(len(text), dtype=bool)
    if len(text):
        before[0] = False
        before[1:] = is_word[:-1]
    begins = np.flatnonzero(is_word & (~before | first[:-1]))
    after = np.empty(len(text), dtype=bool)
    if len(text):
        after[-1] = False
        after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | first[1:])) + 1
    power, inverse = _powers(len(text) + 1)
    total = np.zeros(len(text) + 1, dtype=_U)
    np.cumsum(_VALUE[text] * power[: len(text)], out=total[1:])
    hashed = mix64((total[ends] - total[begins]) * inverse[begins] + (ends - begins).astype(_U))
    doc = np.searchsorted(bounds, begins, side="right") - 1
    return hashed, begins + start, ends + start, doc


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and offsets by document.

    A document with fewer than ``width`` words has its whole sequence as one shingle."""
    counts = np.bincount(doc, minlength=n_docs)
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1])) if n_docs else np.zeros(0, dtype=np.int64)
    full = max(0, len(words) - width + 1)
    acc = np.zeros(full, dtype=_U)
    for j in range(width):
        acc = acc * _U(_BASE) + words[j: j + full]
    keep = doc[:full] == doc[width - 1: width - 1 + full] if full else np.zeros(0, dtype=bool)
    values, owner = [mix64(acc[keep] + _U(width))], [doc[:full][keep]]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        acc = np.zeros(len(short), dtype=_U)
        for j in range(width - 1):
            has = counts[short] > j
            at = np.minimum(firsts[short] + j, len(words) - 1)
            acc = np.where(has, acc * _U(_BASE) + words[at], acc)
        values.append(mix64(acc + counts[short].astype(_U)))
        owner.append(short)
    hashed, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    if len(hashed):
        new = np.ones(len(hashed), dtype=bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
        hashed, owner = hashed[new], owner[new]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n_docs))))
    return hashed, offsets
