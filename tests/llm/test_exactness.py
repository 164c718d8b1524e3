"""Cases named in reviews: colliding hashes, hot keys, long texts, and models against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canlens.llm import exact_index, langid, repeats, toxicity

SCHEMA = "doc_id bigint, text string, hash int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n") for i, t in rows], SCHEMA)


# ---- exact index


def groups_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").lower(), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[(t or "").lower()], len(groups[(t or "").lower()])) for i, t in rows), key=repr)


@pytest.mark.parametrize(("hot", "capacity"), [(1000, 4), (1, 1), (2, 1024)])
def test_colliding_hashes_are_told_apart_by_bytes(spark, monkeypatch, hot, capacity):
    """Four hashes for all texts: chains hold many texts, hot and cold, and lookups find theirs."""
    keyed = exact_index.keyed
    monkeypatch.setattr(exact_index, "keyed", lambda *a: keyed(*a).withColumn("hash", F.shiftleft(F.pmod(F.col("hash"), F.lit(4)), 62)))
    monkeypatch.setattr(exact_index, "HOT", hot)
    rng = random.Random(hot)
    texts = [f"Text {k} " * rng.randint(1, 5) for k in range(25)] + [None, "", "TEXT 3 "]
    rows = [(k, rng.choice(texts)) for k in range(120)] + [(None, "text 0 "), (None, "only null"), (7, "text 1 ")]
    got = exact_index.exact_groups(table(spark, rows).repartition(3), capacity=capacity)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got.collect()), key=repr) == groups_by_hand(rows)


def test_probe_of_other_texts(spark, tmp_path):
    rows = [(k, f"text {k % 30}") for k in range(200)]
    exact_index.build_index(table(spark, rows), str(tmp_path / "index"), capacity=2)
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_index.probe(table(spark, [(1, "TEXT 4"), (2, "text 44"), (3, None)]), str(tmp_path / "index")).collect()}
    assert found == {1: (184, 7), 2: (None, None), 3: (None, None)}


def test_directory_follows_the_counts(spark, monkeypatch):
    """Buckets hold the capacity at most at any number of hashes; slots cover the directory once."""
    hashes = spark.range(3000).select(F.xxhash64("id").alias("hash"))
    slots, depth = exact_index.directory_of(hashes, 2)
    rows = slots.collect()
    assert sorted(r.slot for r in rows) == list(range(1 << depth)) and depth >= 11
    held = exact_index._owned(hashes, slots, depth).groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert held <= 2


# ---- repeats


def removed_by_hand(rows, length):
    where = {}
    for r, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for at in range(len(raw) - length + 1):
            where.setdefault(raw[at: at + length], []).append((r, at))
    gone = [set() for _ in rows]
    for places in where.values():
        if len(places) > 1:
            for r, at in places:
                gone[r].update(range(at, at + length))
    out = []
    for (i, t), bytes_ in zip(rows, gone, strict=True):
        raw = (t or "").encode()
        out.append((i, len(bytes_), hashlib.sha256(bytes(b for k, b in enumerate(raw) if k not in bytes_)).hexdigest()))
    return sorted(out, key=repr)


def test_null_ids_whose_hashes_meet(spark):
    """Two rows without an id, one with a repeat, whose texts have the same 32-bit hash of Spark."""
    rng = random.Random(4)
    block = "".join(rng.choice("abcdefgh") for _ in range(260))
    plain = "".join(rng.choice("ijklmnop") for _ in range(300))
    a = spark.range(250_000).select(F.concat(F.lit(block), F.lit("-"), F.col("id").cast("string")).alias("a"))
    b = spark.range(250_000).select(F.concat(F.lit(plain), F.lit("-"), F.col("id").cast("string")).alias("b"))
    pair = a.join(b, F.hash("a") == F.hash("b")).orderBy("a").first()
    assert pair is not None
    rows = [(None, pair.a), (None, pair.b), (5, block), (5, plain[:150]), (5, block)]
    got = repeats.remove_repeats(table(spark, rows))
    assert sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == removed_by_hand(rows, 200)


@pytest.mark.parametrize("hot", [2048, 3])
def test_hot_anchors_are_decided_by_factors(spark, monkeypatch, hot):
    """One passage in many documents, with different surroundings and edits at several distances."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(hot)

    def noise(n):
        return "".join(rng.choice("abcdefghijkl mnop") for _ in range(n))

    passage = noise(420)
    rows = []
    for k in range(40):
        own = list(passage)
        if k % 3:
            own[rng.randrange(len(own))] = "#"
        lo = rng.randrange(60)
        rows.append((k, noise(rng.randint(0, 90)) + "".join(own)[lo: lo + rng.randint(180, 420)] + noise(rng.randint(0, 90))))
    got = repeats.remove_repeats(table(spark, rows).repartition(3))
    assert sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == removed_by_hand(rows, 200)


def test_previous_factors_of_small_texts():
    """Lengths and sources of all previous factors, on texts of few letters."""
    rng = random.Random(8)
    length = 14
    for _ in range(30):
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 60))) for _ in range(rng.randint(1, 4))]
        owner, inside, factor, source = repeats.previous_factors(segments, length)
        windows = [segments[o][i: i + length] for o, i in zip(owner, inside, strict=True)]

        def common(a, b):
            return next((k for k in range(length) if a[k] != b[k]), length)

        for k, w in enumerate(windows):
            best = max((common(w, v) for v in windows[:k]), default=0)
            assert factor[k] == best
            assert source[k] == -1 if best == 0 else source[k] < k and common(w, windows[source[k]]) == best


# ---- toxicity


def chain_by_hand(rows, labels, folds_of, folds, ridge, min_rows=5, min_z=4.0):
    """The chain with dense matrices, plain Newton steps and loops over rows; returns a scoring function."""
    import re

    def words_of(t):
        return {w.lower() for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")}

    sets = [words_of(t) for t in rows]
    y = np.array(labels, dtype=float)
    chosen = set()
    for k in range(y.shape[1]):
        p = y[:, k].mean()
        for w in set().union(*sets):
            held = [i for i, s in enumerate(sets) if w in s]
            if len(held) >= min_rows and 0 < p < 1 and abs(y[held, k].sum() - len(held) * p) / (len(held) * p * (1 - p)) ** 0.5 >= min_z:
                chosen.add(w)
    chosen = sorted(chosen)
    x = np.array([[float(w in s) for w in chosen] for s in sets])

    def newton(a, b):
        a = np.hstack((a, np.ones((len(a), 1))))
        p1 = b.mean()
        each = np.array([0.5 / p1 if v == 1 else 0.5 / (1 - p1) for v in b])
        penalty = np.array([ridge] * (a.shape[1] - 1) + [1e-3])
        w = np.zeros(a.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w = w + np.linalg.solve((a * (each * p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty), a.T @ (each * (b - p)) - penalty * w)
        return w

    models, earlier = [], np.zeros((len(rows), 0))
    for k in range(y.shape[1]):
        a = np.hstack((x, earlier))
        models.append(newton(a, y[:, k]))
        out = np.zeros(len(rows))
        for f in range(folds):
            own = newton(a[folds_of != f], y[folds_of != f, k])
            out[folds_of == f] = np.clip(a[folds_of == f] @ own[:-1] + own[-1], -30, 30)
        earlier = np.hstack((earlier, out[:, None]))

    def score(t):
        z, held = [], words_of(t)
        for w in models:
            a = np.array([float(c in held) for c in chosen] + z)
            z.append(float(np.clip(a @ w[:-1] + w[-1], -30, 30)))
        return [1 / (1 + np.exp(-v)) for v in z]

    return score, chosen


def test_chain_against_plain_version(spark):
    """Probabilities of all documents as by dense matrices and plain loops; more than 128 words are kept."""
    rng = random.Random(2)
    rude = [f"bad{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(150)]
    fine = [f"word{chr(97 + k)}" for k in range(26)]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        low = rng.random() < (0.8 if toxic else 0.2)
        own = rng.choices(fine, k=30) + (rng.sample(rude, 25) if toxic else rng.sample(rude, 1) if rng.random() < 0.1 else []) + (["meh"] if low else [])
        rng.shuffle(own)
        rows.append(" ".join(own).title() + f" x{k}y")
        labels.append((float(low), float(toxic)))
    docs = table(spark, [*enumerate(rows), (2000, None), (2001, ""), (2002, "Badaa " * 3000), (None, rows[0]), (5, "badab badac")])
    given = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(labels)], "doc_id bigint, low int, toxic int")
    got = {r.doc_id: (r.p_low, r.p_toxic) for r in toxicity.classify(table(spark, list(enumerate(rows))).unionByName(docs.where("doc_id >= 2000")), given, ["low", "toxic"], "toxic").collect()}
    copies = {r.doc_id: r.copy for r in table(spark, list(enumerate(rows))).select("doc_id", F.xxhash64("text", F.lit(5)).alias("copy")).collect()}
    folds_of = np.array([copies[k] % 5 for k in range(len(rows))])
    score, chosen = chain_by_hand(rows, labels, folds_of, 5, toxicity.RIDGE)
    assert len(chosen) > 128
    for k in [*range(0, 900, 7), 2000, 2001, 2002]:
        text = {2000: None, 2001: "", 2002: "Badaa " * 3000}.get(k, rows[k] if k < 900 else None)
        assert np.allclose(got[k], score(text), atol=2e-3)
    assert toxicity.classify(docs, given, ["low", "toxic"], "toxic").count() == docs.count()


# ---- language ID


def tongue(rng, letters, n):
    stems = [a + b for a in letters for b in letters]
    return " ".join("".join(rng.choices(stems[:: 3], k=rng.randint(1, 3))) for _ in range(n))


def test_kernel_against_exact_sets():
    """Kernel values by exact n-gram sets, hashed apart from few collisions, and as the mean over parts."""
    rng = random.Random(1)
    texts = [tongue(rng, "abcdeo", 40).encode() for _ in range(6)]
    offsets = np.cumsum([0, *map(len, texts)])
    present = langid.presence(np.frombuffer(b"".join(texts), np.uint8), offsets)
    marks = present.astype(np.float32) / np.sqrt(present.sum(axis=1, keepdims=True))

    def grams(t):
        return {t[i: i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    exact = [[len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5 for b in texts] for a in texts]
    assert np.allclose(langid.kernel(present, marks), exact, atol=0.02)


def test_parts_cover_texts(monkeypatch):
    monkeypatch.setattr(langid, "PART", 10)
    bounds, doc = langid.in_parts(np.array([3, 3, 13, 34, 35]))
    assert bounds.tolist() == [3, 3, 13, 23, 33, 34, 35] and doc.tolist() == [0, 1, 2, 2, 2, 3]


def test_long_texts_among_others(spark):
    """A text of over 1 MB keeps its language and a sure score beside short ones of other languages; ties, repeats and rows without letters too."""
    rng = random.Random(6)
    tongues = {"aa": "abcdeo", "bb": "abcxyu", "cc": "klmnoi"}
    rows = [(k, tongue(rng, tongues[x], 60), x) for k, x in enumerate(list(tongues) * 60)]
    long = [(1000 + k, tongue(rng, tongues[x], 230_000), x) for k, x in enumerate(tongues)]
    assert all(len(t) > 1_000_000 for _, t, _ in long)
    extra = [(2000, None, "aa"), (2001, "123 ... 456", "bb"), (2002, rows[0][1], None), (2003, rows[0][1], "bb"), (None, rows[1][1], "bb")]
    docs = spark.createDataFrame(rows + long + extra, "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    short = np.mean([got[k][1] for k, _, _ in rows])
    for i, _, x in long:
        assert got[i][0] == x and got[i][1] > 0.9 * short
    assert np.mean([got[i][0] == x for i, _, x in rows]) > 0.95
    assert got[2000] == got[2001] == ("und", 0.0) and got[2002][0] == got[2003][0] == got[0][0]
    assert abs(got[2002][1] - got[0][1]) < 1e-5 and abs(got[2003][1] - got[0][1]) < 1e-5  # sums of other batches round differently
