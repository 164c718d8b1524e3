"""Toxicity by a classifier chain over label columns.

The categories are predicted one after another: each is a ridge logistic regression on the
presence of selected words and on the log-odds of the categories before it.  In training,
those earlier log-odds are out-of-fold predictions (the row's fold was left out of the model that
made them), so later links learn how far earlier ones can be trusted.

Training is bounded: ``max_rows`` labelled rows at most, taken by a hash of their id, with copies
of a text reduced to one row.  A link's words are all those in ``MIN_ROWS`` training rows or more whose share of
positive rows differs from the category's significantly (``MIN_Z``).  Document counts of words are summed up by
Spark; only the places of those words in the training rows reach the driver, where each model is fitted by Newton
steps solved by conjugate gradients over those places.  Scoring covers whole texts, row by row.

Words: runs of letters (anything beyond ASCII counts as a letter), lower-cased A-Z.  Null texts
hold no words; labels that are null are left out in training; repeated ids are rows of their own
in scoring; other columns are left out; without any labels all probabilities are null and
nothing is toxic; a category with one class only has that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import ready, tidy, written

MAX_ROWS, FOLDS, RIDGE = 20_000, 5, 0.3
#: Steps of a conjugate gradient solution, at most.
MAX_STEPS = 200
#: A word is selected if it is in so many training rows, and its positive share so many standard errors off.
MIN_ROWS, MIN_Z = 5, 4.0


@dataclass
class Chain:
    """Sorted word hashes; for each category the bias, word weights and weights of earlier log-odds."""

    categories: list[str]
    words: np.ndarray
    links: list[tuple[float, np.ndarray, np.ndarray]]

    def log_odds(self, present: np.ndarray) -> list[np.ndarray]:
        """``present``: a 0/1 matrix of the words; one array of log-odds for each category."""
        found: list[np.ndarray] = []
        for bias, weights, earlier in self.links:
            z = present @ weights + bias
            for w, x in zip(earlier, found, strict=True):
                z = z + w * x
            found.append(np.clip(z, -30, 30))
        return found


class Design:
    """Training rows: the places of the words they hold (row, word), and dense columns; the last is the bias."""

    def __init__(self, row: np.ndarray, word: np.ndarray, n_words: int, dense: np.ndarray):
        self.row, self.word, self.n_words, self.dense = row, word, n_words, dense
        self.width = n_words + dense.shape[1]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.word], minlength=len(self.dense)) + self.dense @ w[self.n_words:]

    def weighed(self, u: np.ndarray, power: int = 1) -> np.ndarray:
        """Column sums of the rows times ``u`` (of the squared columns for a ``power`` of 2)."""
        return np.concatenate((np.bincount(self.word, weights=u[self.row], minlength=self.n_words), (self.dense ** power).T @ u))

    def take(self, keep: np.ndarray) -> Design:
        place = np.cumsum(keep) - 1
        held = keep[self.row]
        return Design(place[self.row[held]], self.word[held], self.n_words, self.dense[keep])

    def beside(self, column: np.ndarray) -> Design:
        """With one more dense column before the bias."""
        return Design(self.row, self.word, self.n_words, np.column_stack((self.dense[:, :-1], column, self.dense[:, -1])))


def solve(times: Callable[[np.ndarray], np.ndarray], target: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """``x`` with ``times(x) = target`` by conjugate gradients, scaled by the diagonal, to two digits or ``MAX_STEPS``.

    A Newton step that is a little off is mended by the next one."""
    x, left = np.zeros(len(target)), target.copy()
    scaled = left / diagonal
    way, size = scaled.copy(), left @ scaled
    least = 1e-4 * max(float(size), 1e-300)
    for _ in range(MAX_STEPS):
        if size <= least:
            break
        ahead = times(way)
        step = size / (way @ ahead)
        x += step * way
        left -= step * ahead
        scaled = left / diagonal
        size, before = left @ scaled, size
        way = scaled + size / before * way
    return x


def fit_logistic(x: Design, y: np.ndarray, ridge: float, start: np.ndarray | None = None, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps from ``start``; the bias isn't penalised.

    The two classes weigh alike in total."""
    positive = y.mean()
    each = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive)) if 0 < positive < 1 else np.ones(len(y))
    w = np.zeros(x.width) if start is None else start.copy()
    penalty = np.full(x.width, ridge)
    penalty[-1] = 1e-3
    z = x.dot(w)

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float(each @ (np.logaddexp(0, z) - y * z) + 0.5 * penalty @ (w * w))

    now = loss(z, w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gradient = x.weighed(each * (y - p)) - penalty * w
        curve = each * p * (1 - p) + 1e-6
        step = solve(lambda v, curve=curve: x.weighed(curve * x.dot(v)) + penalty * v, gradient, x.weighed(curve, 2) + penalty)
        along, part = x.dot(step), 1.0
        while (after := loss(z + part * along, w + part * step)) > now and part > 1e-4:
            part /= 2
        if after > now:
            break
        w, z, before, now = w + part * step, z + part * along, now, after
        if before - now < 1e-8 * now or part * np.abs(step).max() < 1e-4:
            break
    return w


def fit_links(words: Design, labels: np.ndarray, folds: np.ndarray, ridge: float = RIDGE) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The chain's models.  labels: one column per category, NaN where unknown."""
    links, x = [], words
    for k in range(labels.shape[1]):
        known = ~np.isnan(labels[:, k])
        w = fit_logistic(x.take(known), labels[known, k], ridge)
        links.append((float(w[-1]), w[: x.n_words], w[x.n_words: -1]))
        if k + 1 == labels.shape[1]:
            break  # no later link needs its out-of-fold predictions
        out = np.empty(len(labels))
        for fold in np.unique(folds):
            train = known & (folds != fold)
            own = fit_logistic(x.take(train), labels[train, k], ridge, w) if train.any() else w
            out[folds == fold] = np.clip(x.take(folds == fold).dot(own), -30, 30)
        x = x.beside(out)
    return links


def _present(raw: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """0/1 matrix: which words of the sorted vocabulary the documents of the block hold."""
    hashed, _, _, doc = shingles.word_hashes(raw, offsets, shingles.LETTERS)
    found = np.zeros((len(offsets) - 1, len(vocabulary)), dtype=np.float32)
    if len(vocabulary) and len(hashed):
        near = np.zeros(1 << 16, dtype=bool)
        near[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(near[(hashed >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(vocabulary, hashed[maybe]), len(vocabulary) - 1)
        same = vocabulary[at] == hashed[maybe]
        found[doc[maybe[same]], at[same]] = 1
    return found


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for lo, hi in shingles.blocks(offsets):
        for a in range(lo, hi, 1024):
            yield a, min(a + 1024, hi)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_rows: int = MAX_ROWS,
              folds: int = FOLDS, ridge: float = RIDGE, id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """Learn the chain from ``labels`` (id and one 0/1 column for each category); None without labelled rows."""
    ready(docs.sparkSession)
    names = [f"y{k}" for k in range(len(categories))]
    given = labels.select(labels[id_col].cast("bigint").alias("doc_id"), *[labels[c].cast("double").alias(n) for c, n in zip(categories, names, strict=True)])
    n = given.count()
    if not n:
        return None
    share = min(1.0, max_rows / n)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 32)
    given = given.where(draw < F.lit(int(share * (1 << 32)))).orderBy(draw, "doc_id").limit(max_rows)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    train = rows.join(F.broadcast(given), "doc_id")  # max_rows rows at most
    train = train.withColumn("copy", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(5)))
    train = train.groupBy("copy").agg(F.min_by(F.struct("text", *names), "doc_id").alias("row")).select("copy", "row.*")
    train = written(train, "toxicity-train")
    if train.isEmpty():
        return None

    def words_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column("text"))
            for lo, hi in shingles.blocks(offsets):
                hashed, _, _, doc = shingles.word_hashes(raw, offsets[lo: hi + 1], shingles.LETTERS)
                pairs = np.unique(np.stack((doc.astype(np.uint64), hashed)), axis=1)
                at = pa.array(pairs[0].astype(np.int64) + lo)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), *[batch.column(c).take(at) for c in names]], names=["word", *names])

    counts = train.mapInArrow(tidy(words_of), ", ".join(["word bigint", *[f"{c} double" for c in names]]))
    counts = counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in names], *[F.count(c).alias(f"n_{c}") for c in names])
    counts = written(counts, "toxicity-words")
    share_of = train.agg(*[F.avg(c).alias(c) for c in names]).first()
    chosen: set[int] = set()
    for c in names:
        p = share_of[c]
        if p is None or not 0 < p < 1:
            continue
        z = F.abs(F.col(c) - F.col(f"n_{c}") * p) / F.sqrt(F.col(f"n_{c}") * F.lit(p * (1 - p)))
        # each is in MIN_ROWS of the max_rows training rows
        chosen |= {r["word"] for r in counts.where((F.col(f"n_{c}") >= MIN_ROWS) & (z >= MIN_Z)).select("word").collect()}
    vocabulary = np.sort(np.array(sorted(chosen), dtype=np.int64).view(np.uint64))

    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column("text"))
            held = [np.flatnonzero(row).astype(np.int32) for lo, hi in _blocks(offsets) for row in _present(raw, offsets[lo: hi + 1], vocabulary)]
            yield pa.RecordBatch.from_arrays([batch.column("copy"), pa.array(held, pa.list_(pa.int32())), *[batch.column(c) for c in names]], names=["copy", "held", *names])

    # max_rows rows with the selected words that each holds
    got = train.mapInArrow(tidy(places), ", ".join(["copy bigint, held array<int>", *[f"{c} double" for c in names]])).orderBy("copy").toPandas()
    sizes = got["held"].map(len).to_numpy()
    words = Design(np.repeat(np.arange(len(got)), sizes), np.concatenate([np.zeros(0, np.int32), *got["held"]]).astype(np.int64), len(vocabulary), np.ones((len(got), 1)))
    return Chain(list(categories), vocabulary, fit_links(words, got[names].to_numpy(dtype=float), got["copy"].to_numpy() % folds, ridge))


def score(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id and ``p_<category>`` for each category of the chain."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    if chain is None:
        return rows.select("doc_id")
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(chain)  # a bounded vocabulary and its weights

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column("text"))
            for lo, hi in _blocks(offsets):
                odds = chain.log_odds(_present(raw, offsets[lo: hi + 1], chain.words))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *[pa.array(1 / (1 + np.exp(-z.astype(float)))) for z in odds]], names=names)

    names = ["doc_id", *[f"p_{c}" for c in chain.categories]]
    return rows.mapInArrow(tidy(run), ", ".join(["doc_id bigint", *[f"{n} double" for n in names[1:]]]))


def classify(docs: DataFrame, labels: DataFrame, categories: Sequence[str], target: str, threshold: float = 0.5,
             id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """Fit the chain and score all rows; ``rejected``: the target's probability reaches the threshold."""
    chain = fit_chain(docs, labels, categories, id_col=id_col, text_col=text_col, **fitting)
    found = score(docs, chain, id_col, text_col)
    if chain is None:
        return found.select("doc_id", *[F.lit(None).cast("double").alias(f"p_{c}") for c in categories], F.lit(False).alias("rejected"))
    return found.withColumn("rejected", F.col(f"p_{target}") >= threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, categories: Sequence[str], target: str, threshold: float = 0.5,
               id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """The rows of ``docs``, all columns, that the chain doesn't reject; all of them without labels."""
    chain = fit_chain(docs, labels, categories, id_col=id_col, text_col=text_col, **fitting)
    if chain is None:
        return docs
    shared = ready(docs.sparkSession).sparkContext.broadcast(chain)
    at = list(categories).index(target)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in parts:
            raw, offsets = shingles.utf8_column(batch.column(text_col))
            odds = [chain.log_odds(_present(raw, offsets[lo: hi + 1], chain.words))[at] for lo, hi in _blocks(offsets)]
            clean = 1 / (1 + np.exp(-np.concatenate(odds).astype(float))) < threshold if odds else np.zeros(0, dtype=bool)
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(tidy(run), docs.schema)
