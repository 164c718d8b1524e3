"""Lexical search, collocations and SimHash against brute force on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from canlens.llm import collocations, lexical, simhash, wordlists

SCHEMA = "doc_id bigint, text string, lang string, rank string, item_id string, print int, component_id string, score string, part int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "r", "i", 1, "c", "s", 2, "n") for i, t, lang in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


ODD = [None, "", " ", "\n\t", "...", "One", "one two", "ONE two three", "naïve café 漢字 a_b x\x00y É é", "x" * 5000, "the cat. the cat! the cat " * 700, "word " * 3000]


def mixed(seed=3, n=160):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "cat", "sat", "mat", "Éa", "über", "née", *(f"w{k}" for k in range(60))]
    weights = [40, 30, 20, 5, 5, 5, 3, 3, 3, *(1 for _ in range(60))]

    def text(k):
        return "".join(w + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n"]) for w in rng.choices(vocabulary, weights, k=k))

    base = [text(rng.randint(1, 260)) for _ in range(n)]
    rows = [(k, t, ["en", "de", None, "fr"][k % 4]) for k, t in enumerate([*ODD, *base])]
    rows += [(500 + k, t.upper(), "en") for k, t in enumerate(base[:6])] + [(600, base[0], "en"), (600, base[0], "en"), (None, base[1], "de"), (None, None, None)]
    for k in range(12):  # near copies of one text
        words = base[9].split()
        words[k % len(words)] = "changed"
        rows.append((700 + k, " ".join(words * 3) + f" {k}", "en"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return mixed()


def test_slices_keep_all_words(monkeypatch):
    raw = ("abc def. " * 40 + "x" * 90 + " tail").encode()
    for limit in (1, 7, 50, 10_000):
        parts = list(wordlists.slices(raw, wordlists.SPACE, limit))
        assert b"".join(parts) == raw
        assert [w for p in parts for w in p.split()] == raw.split()


# ---- lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked_by_hand(rows, items, top=50):
    docs = [(i, Counter(TERM.findall(lower(t)))) for i, t, _ in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, counts in docs:
            n = counts.total()
            m = 50 + (50 * n * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in set(TERM.findall(lower(text))) if counts[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item_id, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


ITEMS = [(1, "the cat sat on the MAT w1"), (2, None), (3, "..."), (4, "w3 w4 w5 w6 w7 w8 w9"), (4, "über É é née"), (None, "漢字 x"), (7, " ".join(f"w{k}" for k in range(60)) + " " + " ".join(f"no{k}" for k in range(70)) + " the of")]


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "d") for i, t in items], "item_id bigint, text string, doc_id string")


@pytest.mark.parametrize(("top", "block", "chunk"), [(50, 8192, 2048), (5, 16, 2)])
def test_lexical_search(spark, rows, monkeypatch, top, block, chunk):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "CHUNK_ITEMS", chunk)
    found = lexical.search(table(spark, rows).repartition(3), items_of(spark, ITEMS), top=top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == ranked_by_hand(rows, ITEMS, top)


def test_lexical_search_stops_early(monkeypatch):
    """Blocks of documents that can't get in aren't evaluated; those that tie are."""
    n = 4000
    weights = np.array([1000, 10], dtype=np.int64)
    block = lexical.Block(np.full(n, 10), np.arange(n), (np.arange(n) >= 100).astype(np.int64), np.ones(n, dtype=np.int64), weights, n, 10 * n)
    none = np.zeros(0, dtype=np.int64)
    seen = []
    scored = block.score
    monkeypatch.setattr(block, "score", lambda t, d: seen.append(len(d)) or scored(t, d))
    ids = np.arange(n)[::-1].copy()
    best = lexical.evaluate(block, np.array([0, 1]), ids, np.ones(n, dtype=bool), (none, none.astype(bool), none), 50)
    assert sum(seen) == 100
    assert best[0].tolist() == sorted(ids[:100])[:50]


def test_lexical_search_empty(spark, rows):
    none = table(spark, [])
    assert lexical.search(none, items_of(spark, ITEMS)).collect() == []
    assert lexical.search(table(spark, rows), items_of(spark, [])).collect() == []


# ---- collocations


def collocations_by_hand(rows, min_count, percent=80, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i: i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) >= 2 and a >= min_count}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i: i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("min_count", "budget", "chunk", "limit"), [(30, 1 << 17, 12 << 20, 1 << 20), (4, 40, 3000, 200), (2, 4, 12 << 20, 60)])
def test_collocations(spark, rows, monkeypatch, min_count, budget, chunk, limit):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(collocations, "SLICE_BYTES", limit)
    monkeypatch.setattr(collocations, "slices", lambda raw, sep: wordlists.slices(raw, sep, limit))
    found = collocations.collocations(table(spark, rows).repartition(3), min_count=min_count, budget=budget)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == collocations_by_hand(rows, min_count)


def test_words_whose_hashes_meet(spark, rows, monkeypatch):
    """Numbers go by bytes where hashes of different words meet."""
    mix = collocations.shingles.mix64
    monkeypatch.setattr(collocations.shingles, "mix64", lambda x: mix(x) >> np.uint64(58))
    found = collocations.word_counts(table(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "text"))
    want = Counter()
    for _, text, lang in rows:
        for w in re.findall("[^\x20\x09.,;:!?\x0a-\x0d]+", lower(text)):
            want[lang or "und", w] += 1
    assert {(r.lang, bytes(r.phrase).decode()): r.n for r in found.collect()} == want


def test_collocation_ranks_stop_at_top(spark, rows):
    found = collocations.collocations(table(spark, rows), min_count=3, top=7)
    assert sorted(tuple(r) for r in found.collect()) == collocations_by_hand(rows, 3, top=7)


def test_collocations_of_full_maps(spark, rows, monkeypatch):
    """With every bit of the maps set, nothing is left out early and every prefix is extended: same counts."""
    monkeypatch.setattr(collocations, "bit_map", lambda places: b"\xff" * (1 << collocations.MAP_BITS >> 3))
    found = collocations.collocations(table(spark, rows), min_count=5, budget=64)
    assert sorted(tuple(r) for r in found.collect()) == collocations_by_hand(rows, 5)


def test_only_suffixes_of_three_words_are_shuffled(spark, rows, monkeypatch):
    """Pairs are counted once, by their words; the suffix tree gets what is longer."""
    seen = []
    kept = collocations.written
    monkeypatch.setattr(collocations, "written", lambda df, name: seen.append((name, kept(df, name))) or seen[-1][1])
    counts, _ = collocations.phrase_counts(table(spark, rows), min_count=4)
    suffixes = dict(seen)["phrase-suffixes"].collect()
    assert suffixes and all(bytes(r.phrase).count(b" ") >= 2 for r in suffixes)
    pairs = Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            pairs.update((lang or "und", f"{a} {b}") for a, b in zip(words, words[1:]))
    found = [((r.lang, bytes(r.phrase).decode()), r.n) for r in counts.where("words = 2").collect()]
    assert sorted(found) == sorted((p, n) for p, n in pairs.items() if n >= 4)


def test_collocations_of_clashing_words(spark, rows, monkeypatch):
    """Where the hash of a frequent word is another word's too, pairs are counted by their bytes."""
    counts = spark.createDataFrame([("en", b"a", 9, 5), ("en", b"b", 1, 5), ("de", b"a", 9, 7)], "lang string, phrase binary, n bigint, hash bigint")
    assert collocations.clashing(counts, 9) and not collocations.clashing(counts, 10)
    assert not collocations.clashing(counts.where("n > 1"), 1)
    monkeypatch.setattr(collocations, "clashing", lambda words, min_count: True)
    monkeypatch.setattr(collocations, "named_pairs", None)
    found = collocations.collocations(table(spark, rows).repartition(3), min_count=4, budget=40)
    assert sorted(tuple(r) for r in found.collect()) == collocations_by_hand(rows, 4)


def test_segments_hold_each_phrase_once(monkeypatch):
    text = ("a b c d e f g " * 9 + ". x y z ").encode() * 3

    def grams(parts, size):
        found = Counter()
        for part, limit in parts:
            at = 0
            for piece in re.split(rb"(?<=[.])", part):
                words = [(at + m.start(), m.group()) for m in re.finditer(rb"[^ .]+", piece)]
                found.update(tuple(w for _, w in words[i: i + size]) for i in range(len(words) - size + 1) if words[i][0] < limit)
                at += len(piece)
        return found

    for limit in (1, 3, 20, 33, 100):
        monkeypatch.setattr(collocations, "slices", lambda raw, sep, limit=limit: wordlists.slices(raw, sep, limit))
        for size in range(1, 5):
            assert grams(collocations.segments(text), size) == grams([(text, len(text))], size)


def test_collocations_empty(spark):
    assert collocations.collocations(table(spark, [])).collect() == []


# ---- SimHash


def print_by_hand(text, width=4):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    grams = [" ".join(words[i: i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, ids):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                up[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(prints))]


@pytest.mark.parametrize(("limit", "block", "short"), [(1 << 20, 2048, 16), (50, 3, 2)])
def test_simhash(spark, rows, monkeypatch, limit, block, short):
    monkeypatch.setattr(simhash, "slices", lambda raw, sep: wordlists.slices(raw, sep, limit))
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT", short)
    found = simhash.near_duplicates(table(spark, rows).repartition(3))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [print_by_hand(t) for _, t, _ in rows]
    want = [(i, f"{p:016x}", c) for (i, _, _), p, c in zip(rows, prints, components_by_hand(prints, [i for i, _, _ in rows]), strict=True)]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert any(c not in (None, i) for i, _, c in want)


def ring(rng, n, spread):
    """Fingerprints in chains: each a few bits from an earlier one."""
    prints = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    while len(prints) < n:
        x = prints[int(rng.integers(len(prints)))]
        for b in rng.choice(64, int(rng.integers(1, spread)), replace=False):
            x ^= 1 << int(b)
        prints.append(x)
    return sorted(set(prints))


@pytest.mark.parametrize(("block", "short"), [(2048, 16), (7, 2), (40, 0)])
def test_pigeonring_loses_no_link(spark, monkeypatch, block, short):
    """Groups of random and chained fingerprints are those of all pairs, in whole and split keys."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT", short)
    prints = ring(np.random.default_rng(block), 500, 8)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "print bigint").repartition(4)).collect()
    assert all(bin((r.x ^ r.y) & (1 << 64) - 1).count("1") <= 4 for r in found)
    want = components_by_hand(prints, list(range(len(prints))))
    up = {x: x for x in signed}
    for r in found:
        a, b = r.x, r.y
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[a] = b

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    groups, wanted = defaultdict(set), defaultdict(set)
    for k, x in enumerate(signed):
        groups[root(x)].add(k)
        wanted[want[k]].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_every_close_pair_shares_a_key():
    """A pair at 4 bits or fewer has a start whose chain is viable and whose key is shared."""
    rng = random.Random(9)
    for _ in range(4000):
        apart = [0] * 8
        for b in rng.sample(range(64), rng.randint(0, 4)):
            apart[b // 8] += 1
        assert any(all(apart[(s + p) % 8] == 0 for p in places) and all(sum(apart[(s + j) % 8] for j in range(n + 1)) <= simhash.BUDGETS[n] for n in range(8)) for s in range(8) for places in simhash.PATTERNS)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(table(spark, [])).collect() == []
