"""Language identification by string kernels: blended-spectrum presence, Nystrom landmarks, ridge.

A text is the set of its byte n-grams of all lengths 1 to ``MAX_N`` (lower-cased A-Z), hashed
to ``BITS`` bits of buckets.  The kernel of two texts is the number of buckets they share over
the geometric mean of their sizes.  A set fills up as a text grows, so texts are taken in parts of ``PART`` bytes, and
a text's kernel value is the mean of its parts'.  Landmark parts give each text a vector of kernel values
(Nystrom features); one-versus-rest kernel ridge regression on those is solved in closed form.
A text's scores are then two matrix products over a batch of presence rows.

Training is bounded: about ``max_rows`` parts of labelled texts at most, about as many texts for each language, taken
by a hash of their id, and ``n_landmarks`` of them as landmarks.  Scoring covers whole texts, row by row.

A text that is null or holds no letter is ``und`` with score 0, as is every text if there is
nothing to learn from.  Rows without a language aren't learned from; a null id counts as not held
out but isn't learned from; repeated rows get the same result; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import ready, tidy

#: Bytes of a part; its grams fill about half the buckets at most.
PART = 1 << 15
BITS, MAX_N, MAX_ROWS, N_LANDMARKS, RIDGE = 14, 4, 4096, 256, 1e-3
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # presence rows, divided by the root of their sizes
    weights: np.ndarray  # landmarks x languages

    def scores(self, present: np.ndarray) -> np.ndarray:
        return kernel(present, self.landmarks) @ self.weights


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def presence(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Boolean rows of the n-gram buckets of each document of the block."""
    start, n_docs = int(offsets[0]), len(offsets) - 1
    code = _LOWER[raw[start: int(offsets[-1])]]
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(offsets))
    found = np.zeros(n_docs << BITS, dtype=bool)
    gram = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, min(MAX_N, len(code)) + 1):
        gram = (gram[: len(code) - n + 1] << np.uint32(8)) | code[n - 1:]
        mixed = (gram + np.uint32(n)) * np.uint32(0x85EBCA6B)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        inside = doc[: len(gram)] == doc[n - 1:]
        found[((doc[: len(gram)] << BITS) + (mixed >> np.uint32(32 - BITS)))[inside]] = True
    return found.reshape(n_docs, 1 << BITS)


def in_parts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the parts of the documents, and each part's document.  An empty document is one part."""
    parts = np.maximum(-(-np.diff(offsets) // PART), 1)
    doc = np.repeat(np.arange(len(parts)), parts)
    first = np.cumsum(parts) - parts
    return np.append(offsets[doc] + (np.arange(len(doc)) - first[doc]) * PART, offsets[-1]), doc


def kernel(present: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    x = present.astype(np.float32)
    size = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return (x @ landmarks.T) / size


def fit_ridge(present: np.ndarray, langs: list[str], n_landmarks: int = N_LANDMARKS, ridge: float = RIDGE) -> Model:
    """present: training rows in random order.  Landmarks: the first rows of each language, in turn."""
    names = sorted(set(langs))
    code = np.array([names.index(x) for x in langs])
    turn = np.zeros(len(code), dtype=np.int64)
    for k in range(len(names)):
        turn[code == k] = np.arange(np.sum(code == k))
    chosen = np.lexsort((code, turn))[:n_landmarks]
    marks = present[chosen].astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.concatenate([kernel(present[lo: lo + 512], marks) for lo in range(0, len(present), 512)]).astype(float) @ root
    each = 1 / np.bincount(code)[code]  # languages weigh alike
    y = np.where(code[:, None] == np.arange(len(names)), 1.0, -1.0)
    solved = np.linalg.solve((x * each[:, None]).T @ x + ridge * np.eye(x.shape[1]), (x * each[:, None]).T @ y)
    return Model(names, marks, (root @ solved).astype(np.float32))


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, n_landmarks: int = N_LANDMARKS, ridge: float = RIDGE,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from the rows that aren't held out and have a language; None if there are none."""
    ready(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()}
    if not counts:
        return None
    each = max(1, max_rows // len(counts))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)), 32)
    shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, each / n) * (1 << 32))) for k, n in counts.items()], "lang string, below bigint")
    sample = rows.join(F.broadcast(shares), "lang").where(draw < F.col("below"))  # max_rows languages at most

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column("text"))
            bounds, doc = in_parts(offsets)
            packed = [np.packbits(presence(raw, bounds[k: k + 2])[0]).tobytes() for k in range(len(doc))]
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("draw").take(at), batch.column("lang").take(at), pa.array(packed, pa.binary())], names=["draw", "lang", "bits"])

    sample = sample.select(draw.alias("draw"), "lang", "text").mapInArrow(tidy(pack), "draw bigint, lang string, bits binary")
    got = sample.orderBy("draw", "lang", "bits").limit(max_rows).collect()  # max_rows x 2 KB
    if not got:
        return None
    present = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in got), dtype=np.uint8).reshape(len(got), -1), axis=1).astype(bool)
    return fit_ridge(present, [r["lang"] for r in got], n_landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) for every row."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # bounded by landmarks and languages

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column("text"))
            known = [x is not None and has_letter(x) for x in batch.column("text").to_pylist()]
            langs, sure = [], []
            bounds, doc = in_parts(offsets)
            found = [model.scores(presence(raw, bounds[a: min(a + 256, hi) + 1])) for lo, hi in shingles.blocks(bounds) for a in range(lo, hi, 256)]
            if found:
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                s = np.add.reduceat(np.concatenate(found), first) / np.bincount(doc)[:, None]
                e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                langs = [model.langs[k] for k in s.argmax(axis=1)]
                sure = (e.max(axis=1) / e.sum(axis=1)).tolist()
            langs = [x if ok else UNKNOWN for x, ok in zip(langs, known, strict=True)]
            sure = [float(x) if ok else 0.0 for x, ok in zip(sure, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    return predict(docs, fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **fitting), id_col, text_col)
