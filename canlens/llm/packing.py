"""Harmonic packing of token sequences, independently in each task.

Classes are reciprocal: class j takes pieces of capacity/(j+1) < length <= capacity/j, and a
bin of class j closes when it holds exactly j pieces.  A document is cut into whole
capacities (class 1); the rest stays whole if a bin of its class would be filled to
``1 - slack`` at least, otherwise its largest power of two is cut off (whose class fills a bin
exactly) and the remainder is treated alike.  What is left in open bins at the end of a task is
cut into powers of two and laid together in power-of-two sequences, which need no padding.
No shuffle; the state of a task is its open bins: fewer than j pieces in class j.

Null text counts as empty: such a document is the closing id alone.  Repeated rows are packed
as rows of their own; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .common import ready, texts_of, tidy

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def cut(length: int, capacity: int, slack: float) -> list[int]:
    """Piece lengths of a document, each of them at most ``capacity``."""
    sizes = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        if (capacity // rest) * rest >= capacity * (1 - slack):
            sizes.append(rest)
            break
        sizes.append(1 << (rest.bit_length() - 1))
        rest -= sizes[-1]
    return sizes


def powers(length: int) -> list[int]:
    """``length`` as descending powers of two."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class HarmonicPacker:
    """Bins of one task.  ``add`` and ``finish`` return the pieces of the bins they closed."""

    def __init__(self, capacity: int, slack: float, first_id: int):
        self.capacity, self.slack, self.next_id = capacity, slack, first_id
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for size in cut(len(ids), self.capacity, self.slack):
            kind = self.capacity // size
            pieces = self.open[kind]
            pieces.append((doc, start, ids[start: start + size].copy(), len(ids)))
            start += size
            if len(pieces) == kind:
                yield from self._close(self.open.pop(kind))

    def finish(self) -> Iterator[tuple]:
        by_size: dict[int, list[tuple]] = defaultdict(list)
        for kind in sorted(self.open):
            for doc, start, ids, total in self.open[kind]:
                for size in powers(len(ids)):
                    by_size[size].append((doc, start, ids[:size], total))
                    start, ids = start + size, ids[size:]
        self.open.clear()
        room = 1 << (self.capacity.bit_length() - 1)
        for size, pieces in sorted(by_size.items()):
            while pieces:
                n = min(room // size, 1 << (len(pieces).bit_length() - 1))
                yield from self._close(pieces[:n])
                del pieces[:n]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, slack: float = 1 / 128,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``sequence_id`` is the task's number in the upper and the bin's in the lower 32 bits."""
    spark = ready(docs.sparkSession)
    source = spark.sparkContext.broadcast(bpe.read_tokenizer(tokenizer_path))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    kinds = [pa.int64()] * len(_FIELDS)

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[]] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_FIELDS)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = bpe.encoder(bpe.ByteIds, source.value)
        packer = HarmonicPacker(capacity, slack, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], dtype=ids.dtype)
        for batch in parts:
            found: list[tuple] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), ids.pieces(texts_of(batch)), strict=True):
                found.extend(packer.add(doc, np.concatenate((np.frombuffer(raw, ids.dtype), end))))
            yield out(found)
        yield out(list(packer.finish()))

    return rows.mapInArrow(tidy(pack, keeps=True), SCHEMA)
