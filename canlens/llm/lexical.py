"""Ranked lexical search by presence-mask grouping.

A document's score for an item is the sum, over the item's distinct terms, of the term's weight times a
saturating share of its occurrences (``weights`` and ``impacts``; integers throughout, but for the logarithm).

Documents are read once: each becomes its number of terms and its postings of the items' terms.  What the
weights need (documents N, terms L, documents of each term) is summed over all documents.

Then tasks take blocks of documents.  A block has a bitmap of its documents for each term.  For an item, the
bitmaps of its terms are transposed into a *presence mask* for each document, and documents are grouped by it.
A mask's *bound* is the sum, over its terms, of the largest share that a document of the block has: no document of
that mask scores higher.  Masks are evaluated by descending bound, exactly and for all their documents, until
the bound of the next is below the score that the item's last kept document has; it then can't get in, nor
tie.  Kept documents stay from block to block of a task, so later blocks stop earlier.  The tasks' lists, ``top``
rows an item each, are ranked in two steps.

Items are a stated query set.  They are read in chunks of bounded size (``CHUNK_ITEMS``, ``CHUNK_BYTES``), each
against all documents.

Rows.  Null and empty texts have no terms: such a document scores for nothing and such an item has no rows.  Items with
equal ids are separate items with a ranking each.  A row with a null id is ranked, after its ties; repeated rows rank each;
other columns are left out; an empty table gives no rows.  Texts are read a slice at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, tidy, written
from .wordlists import raw_text, slices

TOP = 50
CHUNK_ITEMS, CHUNK_BYTES = 2048, 4 << 20
#: Documents of a block, and documents evaluated at a time at first.
BLOCK, FIRST = 8192, 256
_TERM = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_TO_TERMS = bytes((c + 32 if 65 <= c <= 90 else c) if c in _TERM else 32 for c in range(256))
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xFF]")


def term_counts(raw: bytes) -> Counter:
    """Occurrences of each term of a text."""
    found: Counter = Counter()
    for part in slices(raw, _BREAK):
        found.update(part.translate(_TO_TERMS).split())
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Saturating share of a term's occurrences; ``length`` is the document's m."""
    return (np.int64(1_000_000_000) * tf) // (np.int64(1000) * tf + np.int64(20) * length)


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each document's m: its number of terms against the mean, in hundredths, halfway to 100."""
    return np.int64(100 - 50) + (np.int64(50) * n * np.int64(n_docs)) // np.int64(max(1, n_terms))


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): number of terms, and the given terms it holds (as places in ``terms``)."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(known.value)}
        for batch in parts:
            n, held, tfs = [], [], []
            for text in batch.column("text"):
                counts = term_counts(raw_text(text.as_py()))
                own = [(place[t], c) for t, c in counts.items() if t in place]
                n.append(counts.total())
                held.append([k for k, _ in own])
                tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(tidy(run), "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Block:
    """A block of documents: a bitmap and the scores of each term's documents."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.size = len(n)
        order = np.argsort(terms, kind="stable")
        terms, self.docs = terms[order], owner[order]
        self.scores = weights[terms] * impacts(tfs[order], lengths(n, n_docs, n_terms)[self.docs])
        self.bounds = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), dtype=np.int64)
        held = np.flatnonzero(np.diff(self.bounds))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.scores, self.bounds[held])
        self.maps: dict[int, np.ndarray] = {}

    def bitmap(self, term: int) -> np.ndarray:
        """One bit for each document: whether it holds the term."""
        if term not in self.maps:
            bits = np.zeros(self.size, dtype=bool)
            bits[self.docs[self.bounds[term]: self.bounds[term + 1]]] = True
            self.maps[term] = np.packbits(bits)
        return self.maps[term]

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each distinct presence mask of the given terms, and each document's mask (as its place)."""
        rows = np.unpackbits(np.stack([self.bitmap(int(t)) for t in terms]), axis=1, count=self.size)
        bits = np.packbits(rows, axis=0)
        bits = np.ascontiguousarray(np.pad(bits, ((0, -len(bits) % 8), (0, 0))).T).view(np.uint64)
        group = np.zeros(self.size, dtype=np.int64)
        for k in range(bits.shape[1]):
            _, code = np.unique(bits[:, k], return_inverse=True)
            _, group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)
        _, one = np.unique(group, return_index=True)  # a document of each mask
        return self.most[terms] @ rows[:, one].astype(np.int64), group

    def score(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of documents (ascending places)."""
        total = np.zeros(len(docs), dtype=np.int64)
        for t in terms:
            a, b = self.bounds[t], self.bounds[t + 1]
            at = np.searchsorted(self.docs[a:b], docs)
            at[at == b - a] = 0
            if b > a:
                total += np.where(self.docs[a:b][at] == docs, self.scores[a:b][at], 0)
        return total


def _best(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``top`` by descending score and ascending id, null ids last."""
    order = np.lexsort((ids, ~known, -scores))[:top]
    return ids[order], known[order], scores[order]


def _search(items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    """A stage that turns postings into (item, doc_id, score): ``top`` rows an item and task at most."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        best = [(none, none.astype(bool), none)] * len(items)

        def take(batches: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(batches).combine_chunks()
            ids = table.column("doc_id")
            known, ids = ids.is_valid().to_numpy(), ids.fill_null(0).to_numpy()
            sizes = pc.list_value_length(table.column("terms")).to_numpy()
            flat = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs")]
            block = Block(table.column("n").to_numpy(), np.repeat(np.arange(len(ids)), sizes), flat[0], flat[1], weights, n_docs, n_terms)
            for k, terms in enumerate(items):
                best[k] = evaluate(block, terms, ids, known, best[k], top)

        waiting, rows = [], 0
        for batch in parts:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                take(waiting)
                waiting, rows = [], 0
        if rows:
            take(waiting)
        for k, (ids, known, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k, dtype=np.int32)), pa.array(ids, mask=~known), pa.array(scores)], names=["item", "doc_id", "score"])

    return run


def evaluate(block: Block, terms: np.ndarray, ids: np.ndarray, known: np.ndarray, best: tuple, top: int) -> tuple:
    """``best`` (ids, known, scores) after the block: masks by descending bound until safely finished."""
    if not len(terms) or not block.size:
        return best
    bounds, group = block.masks(terms)
    order = np.argsort(-bounds, kind="stable")
    bounds = bounds[order]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    docs = np.argsort(place[group], kind="stable")  # documents by descending bound of their mask
    ends = np.cumsum(np.bincount(place[group], minlength=len(order)))
    at, done, step = 0, 0, FIRST
    while at < len(bounds) and bounds[at] > 0 and (len(best[2]) < top or bounds[at] >= best[2][-1]):
        upto = max(at + 1, int(np.searchsorted(ends, done + step, side="right")))
        some = np.sort(docs[done: ends[upto - 1]])
        scores = block.score(terms, some)
        good = scores > 0
        best = _best(*(np.concatenate(x) for x in zip(best, (ids[some][good], known[some][good], scores[good]), strict=True)), top)
        at, done, step = upto, int(ends[upto - 1]), 2 * step
    return best


def _chunks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) rows of each chunk; a chunk's expected size is half the bounds."""
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = 1 if n <= CHUNK_ITEMS and size <= CHUNK_BYTES else max(-(-2 * n // CHUNK_ITEMS), -(-2 * size // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks))
    for k in range(chunks):
        rows = [tuple(r) for r in items.where(chunk == k).collect()]
        if rows:
            yield rows


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``top`` documents of each item: item_id, rank (from 1), doc_id, score."""
    spark = ready(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    asked = items.select(items[item_col].alias("item_id"), items[item_text].alias("text"))
    found = None
    for rows in _chunks(asked):
        part = _ranked(texts, rows, top, asked.schema["item_id"].dataType.simpleString())
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    return found


def _ranked(texts: DataFrame, rows: list[tuple], top: int, item_type: str) -> DataFrame:
    spark = texts.sparkSession
    own = [sorted(term_counts(raw_text(text))) for _, text in rows]
    terms = sorted(set().union(*own))
    held = written(postings(texts, terms), "lexical-postings")
    n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row for each of the chunk's terms
    df = dict(held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect())
    weights = np.array([weight(n_docs, df.get(k, 0)) for k in range(len(terms))], dtype=np.int64)
    place = {t: k for k, t in enumerate(terms)}
    asked = [np.array([place[t] for t in x], dtype=np.int64) for x in own]
    scored = held.select("doc_id", "n", "terms", "tfs").mapInArrow(tidy(_search(asked, weights, n_docs, n_terms, top)), "item int, doc_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    first = written(scored, "lexical-found").withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(rows)], f"item int, item_id {item_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
