"""Phrase collocations by vertical partitioning of a depth-truncated suffix tree.

The texts' suffixes are cut at ``DEPTH`` words and at the end of their piece.  Their tree is never
built whole: it is partitioned by word prefixes, whose subtrees fit a memory budget and are built
independently of each other.

1. *Prefix counts.*  Words are counted for each language, then word by word longer prefixes, as long as all their
   parts occur ``min_count`` times.  A phrase can't occur more often than a part of it, so a suffix is followed
   only as far: what lies below is no candidate nor part of one.  Nodes of one and two words are done with that: pairs
   are counted by the hashes of both words, which the table of words turns into the words again.  Only suffixes of
   three words or more go on; if a frequent word has the hash of another word, those of two words do too.
2. *Vertical partition.*  A prefix is one word.  If more than ``BUDGET`` suffixes start with it, it is
   extended to two words, and a pair above the budget to the whole suffix.  Prefixes are dealt to
   groups by hash, so many groups that one holds about ``BUDGET`` suffixes (a prefix is a bounded part of it).
3. *Subtrees.*  Suffixes are counted by equal ones in each task before they are shuffled.  A group's
   suffixes are sorted; the sorted order is the subtree, and each node's count is the sum of its leaves,
   read in one pass with one open node for each depth.  Nodes of a prefix that was dealt to several groups get
   partial sums, which are added up.

Frequent words and longer prefixes, and heavy prefixes, reach the tasks as bit maps of fixed size: a bit set by
chance lets a suffix be followed or a prefix be extended without need, and changes no count.

A task works on arrays of words (``Words``), a chunk of texts at a time: words are numbered by their hash, checked
by their bytes, and phrases are counted by those numbers; only distinct phrases of a chunk become strings.  Prefix
counts of three words are a filter, so they go by hash alone: what meets by chance is followed without need.  Phrase
counts are exact: chunks give strings, Spark sums them up by their bytes, pairs go by hash only where each hash is one
word's, and products are decimals.

Rows.  Null texts are empty, a null language is ``und``, ids aren't read, other columns are left out;
repeated rows count each time; an empty table gives no rows.  Texts are read a slice at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import ready, tidy, written
from .wordlists import SLICE_BYTES, slices

DEPTH, MIN_COUNT, PERCENT, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
#: Suffixes of a group of prefixes, about; a prefix with more of them is extended.
BUDGET = 1 << 17
#: Bits of each map that tasks get (2 MB each).
MAP_BITS = 24
#: Bytes of texts whose words a task holds at a time.
CHUNK_BYTES = 4 << 20
#: Rows that a task gives on at a time.
GIVEN = 1 << 16
#: Parts that the ranking of one language is dealt to.
PARTS = 64
_U = np.uint64
_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IS_WORD = ~_SEPARATES
_IS_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_TAIL = re.compile(rb"[^.,;:!?\x0A-\x0D]*$")
_WORD = re.compile(rb"[^\x20\x09]+")
_WORDS = [f"w{k}" for k in range(1, DEPTH + 1)]


def segments(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """Parts of a text, each with the byte from which on phrases start in the next part only.

    A piece that a part cuts is given with its last ``DEPTH`` - 1 words to the next part."""
    kept = b""
    cuts = list(slices(raw, _END))
    for k, part in enumerate(cuts):
        part = kept + part
        if k + 1 == len(cuts):
            yield part, len(part)
            return
        tail = _TAIL.search(part).start()
        words = [m.start() for m in _WORD.finditer(part, tail)]
        at = words[1 - DEPTH] if len(words) >= DEPTH else tail
        yield part, at
        kept = part[at:]


def _mixed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 1)


def _extended(hashed: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix and one word more."""
    return shingles.mix64(hashed * _U(0x9E3779B97F4A7C15) + word) | _U(1)


class Words:
    """The words of a chunk: language, hash (of language and word), place, whether phrases start there and
    whether the next word follows in the same piece."""

    def __init__(self, raw: np.ndarray, lang: np.ndarray, hashed: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, joined: np.ndarray, langs: list[str]):
        self.raw, self.lang, self.hashed, self.begin, self.end, self.starts, self.joined, self.langs = raw, lang, hashed, begin, end, starts, joined, langs

    def numbered(self) -> None:
        """Number the words: ``number`` of each, and ``names``, ``name_lang``, ``name_hash`` by number."""
        _, first, self.number = np.unique(self.hashed, return_index=True, return_inverse=True)
        if not self._same(first[self.number]):
            first = self._number_by_bytes()
        text = self.raw.tobytes()
        self.names = [text[a:b] for a, b in zip(self.begin[first].tolist(), self.end[first].tolist(), strict=True)]
        self.name_lang, self.name_hash = self.lang[first], self.hashed[first]

    def _same(self, other: np.ndarray) -> bool:
        """Whether each word has the language, length, first and last eight bytes of another."""
        padded = np.concatenate((np.zeros(8, np.uint8), self.raw, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
        size = self.end - self.begin
        spare = (8 * np.maximum(8 - size, 0)).astype(_U)
        head, tail = eight[self.begin + 8] << spare, eight[self.end] >> spare
        return all(np.array_equal(x, x[other]) for x in (self.lang, size, head, tail))

    def _number_by_bytes(self) -> np.ndarray:
        """Numbers by the bytes themselves, for chunks in which hashes of different words meet."""
        text, known, first = self.raw.tobytes(), {}, []
        for k, key in enumerate(zip(self.lang.tolist(), (text[a:b] for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)), strict=True)):
            if known.setdefault(key, len(first)) == len(first):
                first.append(k)
            self.number[k] = known[key]
        return np.array(first, dtype=np.int64)

    def followed(self, maps: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """For 1, 2 ... words, one length for each map: whether the words from each place on may be frequent, and
        their hash; the last hash is that of one word more, 0 where its parts don't allow it."""
        hashed, found = self.hashed, []
        for k, bits in enumerate(maps):
            if k:
                hashed = self._longer(found[-1], hashed, k)
            good = _has(bits, (hashed >> _U(64 - MAP_BITS)).astype(np.int64))
            found.append(good & (hashed != 0))
        return found, self._longer(found[-1], hashed, len(maps))

    def _longer(self, good: np.ndarray, hashed: np.ndarray, k: int) -> np.ndarray:
        """Hash of the ``k`` + 1 words from each place on whose first and last ``k`` words are ``good``; else 0."""
        out = np.zeros(len(hashed), dtype=_U)
        at = np.flatnonzero(good[:-1] & good[1:] & self.joined[:-1]) if k == 1 else np.flatnonzero(good[:-1] & good[1:])
        out[at] = _extended(hashed[at], self.hashed[at + k])
        return out


def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of the batches' texts (lang, text), ``CHUNK_BYTES`` of them or so at a time."""
    langs: dict[str, int] = {}
    held: list[tuple] = []
    size = 0

    def give() -> Iterator[Words]:
        if held:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            if len(columns[1]):
                yield Words(*columns, list(langs))

    for batch in parts:
        code = np.array([langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()], dtype=np.int64)
        raw, offsets = shingles.utf8_column(batch.column("text"))
        limit = offsets[1:]
        if len(offsets) > 1 and int(np.diff(offsets).max()) > SLICE_BYTES:
            cut = [(x, *s) for x, a, b in zip(code.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for s in segments(raw[a:b].tobytes())]
            code, raw = np.array([c[0] for c in cut]), np.frombuffer(b"".join(c[1] for c in cut), dtype=np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(c[1]) for c in cut])))
            limit = offsets[:-1] + np.array([c[2] for c in cut])
        mixed = np.array([_mixed(x) for x in langs], dtype=_U)
        for lo, hi in shingles.blocks(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            hashed, begin, end, doc = shingles.word_hashes(raw, offsets[lo: hi + 1], _IS_WORD)
            apart = np.concatenate(([0], np.cumsum(_SEPARATES[raw[a:b]])))
            joined = np.zeros(len(begin), dtype=bool)
            joined[:-1] = (doc[1:] == doc[:-1]) & (apart[begin[1:] - a] == apart[end[:-1] - a])
            own = code[lo:hi][doc]
            held.append((_LOWER[raw[a:b]], own, shingles.mix64(hashed ^ mixed[own]) | _U(1), begin - a + size, end - a + size, begin < limit[lo:hi][doc], joined))
            size += b - a
            if size >= CHUNK_BYTES:
                yield from give()
                size = 0
    yield from give()


def _rows(langs: list[str], code: np.ndarray, phrases: list[bytes], n: np.ndarray, hashed: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    names = pa.array(langs, pa.string())
    for k in range(0, len(n), GIVEN):
        to = slice(k, k + GIVEN)
        columns = {"lang": names.take(pa.array(code[to])), "phrase": pa.array(phrases[to], pa.binary()), "n": pa.array(n[to], pa.int64())}
        yield pa.RecordBatch.from_pydict(columns | ({} if hashed is None else {"hash": pa.array(hashed[to].view(np.int64))}))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n, hash) of single words; ``hash`` as in ``Words``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in chunks(parts):
            words.numbered()
            n = np.bincount(words.number[words.starts], minlength=len(words.names))
            yield from _rows(words.langs, words.name_lang, words.names, n, words.name_hash)

    counts = texts.mapInArrow(tidy(run), "lang string, phrase binary, n bigint, hash bigint").where("n > 0")
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.first("hash").alias("hash"))


def _bit(lang: str, phrase: bytes) -> int:
    return xxhash.xxh64_intdigest(phrase, _mixed(lang)) >> (64 - MAP_BITS)


def _maps(kept: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint8) for x in kept]


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_map(places: DataFrame) -> bytes:
    """A map of ``MAP_BITS`` bits with those of ``place`` set; set in tasks and joined by ``bit_or``."""
    word = F.shiftright("place", 6).alias("at")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    rows = places.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2**(MAP_BITS - 6) rows at most
    found = np.zeros(1 << MAP_BITS >> 6, dtype=_U)
    found[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return found.tobytes()


def phrase_map(phrases: DataFrame) -> bytes:
    """The map of (lang, phrase) rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            place = [_bit(x, p) for x, p in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64())], names=["place"])

    return bit_map(phrases.select("lang", "phrase").mapInArrow(tidy(run), "place bigint"))


def hash_map(counts: DataFrame, min_count: int) -> bytes:
    """The map of the rows (hash, n) that occur ``min_count`` times."""
    return bit_map(counts.where(F.col("n") >= min_count).select(F.shiftrightunsigned("hash", 64 - MAP_BITS).alias("place")))


def clashing(words: DataFrame, min_count: int) -> bool:
    """Whether a word that occurs ``min_count`` times has the hash of another word."""
    owners = words.groupBy("hash").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n"))
    return not owners.where((F.col("words") > 1) & (F.col("n") >= min_count)).isEmpty()


def pair_counts(texts: DataFrame, bits: bytes) -> DataFrame:
    """(first, second, n) of the pairs whose words are in the map, by the hashes of the words."""
    keep = texts.sparkSession.sparkContext.broadcast(bits)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = _maps([keep.value])
        for words in chunks(parts):
            both = words.followed(single)[1]
            at = np.flatnonzero(words.starts & (both != 0))
            at = at[np.argsort(both[at])]
            first, second = words.hashed[at], words.hashed[at + 1]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            one = np.flatnonzero(new)
            n = np.diff(np.append(one, len(at)))
            yield pa.RecordBatch.from_arrays([pa.array(first[one].view(np.int64)), pa.array(second[one].view(np.int64)), pa.array(n, pa.int64())], names=["first", "second", "n"])

    return texts.mapInArrow(tidy(run), "first bigint, second bigint, n bigint").groupBy("first", "second").agg(F.sum("n").alias("n"))


def pair_map(pairs: DataFrame) -> bytes:
    """The map of (first, second) rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            first, second = (batch.column(k).to_numpy(zero_copy_only=False).view(_U) for k in ("first", "second"))
            place = (_extended(first, second) >> _U(64 - MAP_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place)], names=["place"])

    return bit_map(pairs.select("first", "second").mapInArrow(tidy(run), "place bigint"))


def named_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, n) of pairs whose hashes are those of one word each."""
    first = words.select(F.col("hash").alias("first"), "lang", F.col("phrase").alias("one"))
    second = words.select(F.col("hash").alias("second"), F.col("phrase").alias("two"))
    return pairs.join(first, "first").join(second, "second").select("lang", F.concat("one", F.lit(b" "), "two").alias("phrase"), "n")


def prefix_counts(texts: DataFrame, maps: list[bytes]) -> DataFrame:
    """(hash, n) of the prefixes of one word more than the maps have, as far as they let them."""
    keep = texts.sparkSession.sparkContext.broadcast(maps)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = _maps(keep.value)
        for words in chunks(parts):
            hashed = words.followed(shorter)[1]
            prefix, n = np.unique(hashed[words.starts & (hashed != 0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    return texts.mapInArrow(tidy(run), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def suffix_counts(texts: DataFrame, maps: list[bytes], least: int) -> DataFrame:
    """(lang, phrase, n): suffixes of ``least`` to ``DEPTH`` words, followed as far as the maps of 1 to ``DEPTH`` - 1 words let them."""
    keep = texts.sparkSession.sparkContext.broadcast(maps)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = _maps(keep.value)
        for words in chunks(parts):
            found, longest = words.followed(shorter)
            words.numbered()
            first = np.flatnonzero(found[least - 1] & words.starts)
            numbers = np.append(words.number, np.zeros(DEPTH, dtype=np.int64))
            columns = [numbers[first], numbers[first + 1] + 1]
            for k in range(2, DEPTH):  # longer ones are followed only where shorter ones are
                on = found[k][first] if k < DEPTH - 1 else longest[first] != 0
                columns.append(np.where(on, numbers[first + k] + 1, 0))
            key = columns[0]
            for column in columns[1:]:  # numbers of longer and longer prefixes
                _, key = np.unique(key << 32 | column, return_inverse=True)
            _, one, n = np.unique(key, return_index=True, return_counts=True)
            rows = np.stack([c[one] for c in columns], axis=1).tolist()
            names = words.names
            phrases = [b" ".join([names[r[0]], *[names[x - 1] for x in r[1:] if x]]) for r in rows]
            yield from _rows(words.langs, words.lang[first[one]], phrases, n)

    counts = texts.mapInArrow(tidy(run), "lang string, phrase binary, n bigint")
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def dealt_suffixes(suffixes: DataFrame, heavy: DataFrame, groups: int) -> DataFrame:
    """(lang, w1 .. w4, n, whole, group): suffixes with the group of their prefix.

    ``heavy`` holds the prefixes above the budget.  ``whole`` is the least depth whose nodes have all their
    leaves in the group: 1 for a light word, 2 below a heavy one, ``DEPTH`` below a heavy pair."""
    keep = suffixes.sparkSession.sparkContext.broadcast(phrase_map(heavy))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(keep.value, dtype=np.uint8)

        def has(lang: str, prefix: bytes) -> bool:
            at = _bit(lang, prefix)
            return bool(bits[at >> 3] >> (at & 7) & 1)

        for batch in parts:
            columns: list[list] = [[] for _ in range(DEPTH)]
            whole, group = [], []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                words = phrase.split(b" ")
                depth = 1
                if has(lang, words[0]):
                    depth = DEPTH if has(lang, b" ".join(words[:2])) else 2
                prefix = b" ".join(words[:depth])
                for k in range(DEPTH):
                    columns[k].append(words[k] if k < len(words) else None)
                whole.append(depth)
                group.append(xxhash.xxh64_intdigest(prefix, _mixed(lang)) % groups)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *(pa.array(c, pa.binary()) for c in columns), batch.column("n"), pa.array(whole, pa.int32()), pa.array(group, pa.int64())],
                                             names=["lang", *_WORDS, "n", "whole", "group"])

    return suffixes.mapInArrow(tidy(run), "lang string, " + ", ".join(f"{w} binary" for w in _WORDS) + ", n bigint, whole int, group bigint")


def _subtrees(min_count: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the nodes from depth ``least`` on of the subtrees whose sorted suffixes come in; memory: one batch and one open path."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None] * (DEPTH + 1)  # for each depth: (lang, words), count, whole depth of the open node
        for batch in parts:
            n = batch.num_rows
            if not n:
                continue
            names = ["lang", *_WORDS]
            differs = np.zeros(n, dtype=bool)
            differs[0] = True
            counts, whole = batch.column("n").to_numpy(), batch.column("whole").to_numpy()
            cells = {name: batch.column(name) for name in names}
            out: list[tuple[str, bytes, int]] = []
            for depth in range(1, DEPTH + 1):
                for name in names[depth if depth > 1 else 0: depth + 1]:
                    column = cells[name].fill_null(b"") if name != "lang" else cells[name]
                    differs[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(differs)
                totals = np.add.reduceat(counts, starts)
                there = np.ones(len(starts), dtype=bool) if depth < 2 else pc.is_valid(cells[names[depth]]).to_numpy(zero_copy_only=False)[starts]
                if depth < least:
                    continue  # shorter prefixes have counts of their own

                def path(k: int, depth: int = depth) -> tuple:
                    return (cells["lang"][k].as_py(), *(cells[w][k].as_py() for w in _WORDS[:depth]))

                last = len(starts) - 1
                # the first run may go on what the last batch left open, the last one stays open
                good = there & ((totals >= min_count) | (whole[starts] > depth))
                good[[0, last]] = False
                out += [(*_named(path(int(k))), int(t)) for k, t in zip(starts[good], totals[good], strict=True)]
                for r in dict.fromkeys((0, last)):
                    node = path(int(starts[r])) if there[r] else None
                    if node is not None and held[depth] is not None and held[depth][0] == node:
                        held[depth] = (node, held[depth][1] + int(totals[r]), held[depth][2])
                    else:
                        out += _closed(held[depth], min_count, depth)
                        held[depth] = (node, int(totals[r]), int(whole[starts[r]])) if node is not None else None
            if out:
                yield _nodes(out)
        out = [x for depth in range(least, DEPTH + 1) for x in _closed(held[depth], min_count, depth)]
        if out:
            yield _nodes(out)

    return run


def _named(path: tuple) -> tuple[str, bytes]:
    return path[0], b" ".join(path[1:])


def _closed(node: tuple | None, min_count: int, depth: int) -> list[tuple[str, bytes, int]]:
    return [(*_named(node[0]), node[1])] if node is not None and (node[1] >= min_count or node[2] > depth) else []


def _nodes(rows: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "phrase", "n"])


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of 1 to ``DEPTH`` words that occur ``min_count`` times, as (lang, phrase, n,
    words) with the phrase as bytes, and (lang, n) of all words."""
    ready(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    words = written(word_counts(texts), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= min_count)
    maps = [hash_map(words, min_count)]
    pairs = written(pair_counts(texts, maps[0]).where(F.col("n") >= min_count), "phrase-pairs")
    maps.append(pair_map(pairs))
    while len(maps) < DEPTH - 1:
        maps.append(hash_map(prefix_counts(texts, maps), min_count))
    least = 2 if clashing(words, min_count) else 3
    suffixes = written(suffix_counts(texts, maps, least), "phrase-suffixes")

    # vertical partition: the prefixes of one and two words with more than a quarter of a group's suffixes
    start = [F.substring_index(F.col("phrase").cast("string"), " ", k).cast("binary").alias("phrase") for k in (1, 2)]
    weights = [suffixes.select("lang", x).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("rows")) for x in start]
    heavy = weights[0].unionByName(weights[1]).where(F.col("rows") > budget // 4)
    rows = int(suffixes.count())
    groups = max(1, -(-rows // budget))
    dealt = dealt_suffixes(suffixes, heavy, groups)
    ordered = dealt.repartition(groups, "group").sortWithinPartitions("group", "lang", *_WORDS)
    nodes = ordered.mapInArrow(tidy(_subtrees(min_count, least)), "lang string, phrase binary, n bigint")
    longer = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    counts = frequent.select("lang", "phrase", "n").unionByName(longer)
    if least > 2:
        counts = counts.unionByName(named_pairs(pairs, frequent))
    depth = F.size(F.split(F.col("phrase").cast("string"), " "))
    return written(counts.withColumn("words", depth), "phrase-counts"), totals


def _part(first: int, last: int) -> Column:
    """Words ``first`` to ``last`` (from 1) of the phrase."""
    return F.array_join(F.slice("list", first, last - first + 1), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, percent: int = PERCENT, top: int = TOP, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(docs, min_count, lang_col, text_col, budget)
    named = counts.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("a"), "words")
    long = named.where(F.col("words") >= 2).withColumn("list", F.split("phrase", " "))

    # candidates inside longer ones: the largest count of a longer one decides
    inner = [F.when((F.col("words") > m) & (F.col("words") >= m + k), _part(k + 1, k + m)) for m in range(2, DEPTH) for k in range(DEPTH - m + 1)]
    inside = long.where(F.col("words") >= 3).select("lang", F.col("a").alias("outer"), F.explode(F.array(*inner)).alias("phrase"))
    most = inside.where(F.col("phrase").isNotNull()).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    big = "decimal(38,0)"
    kept = long.join(most, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.col("outer").cast(big) * 100 < F.col("a").cast(big) * percent))

    # all cuts of a candidate
    cuts = [F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), _part(1, k).alias("first"), _part(k + 1, DEPTH).alias("rest"))) for k in range(1, DEPTH)]
    cut = kept.select("lang", "phrase", "a", F.explode(F.array(*cuts)).alias("cut")).where(F.col("cut").isNotNull())
    cut = cut.select("lang", "phrase", "a", F.col("cut.k").alias("k"), F.col("cut.first").alias("first"), F.col("cut.rest").alias("rest"))
    parts = named.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    both = cut.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = both.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = both.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    rows = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.limit(100_001).count() <= 100_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
