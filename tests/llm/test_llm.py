"""The training-data operators against brute force on small tables: nulls, empty and long texts,
ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from canlens.llm import bpe, common, decontam, exact_index, langid, near_dup, packing, records, repeats, sharding, token_counts, toxicity
from canlens.llm.components import components
from canlens.session import scratch_path

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id bigint, text string, lang string, n_tokens string, size int, component_id string, kept string, hash int, part int"
ODD = [None, "", " ", "\n\n", "a", "A", "don't  STOP <|endoftext|> now", "ß İstanbul ʼn é é 漢字 ²³½ १२ _x_ \x1c\x85\xa0 z", "naïve café — “q” … " * 40, "x" * 30_000, "word " * 9_000]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéfgß") for _ in range(rng.randint(1, 8))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "n", 1, "c", "k", 2, 3) for i, t in rows], SCHEMA)


def mixed():
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 400)) for _ in range(12)]
    rows = list(enumerate(ODD)) + [(100 + k, t) for k, t in enumerate(base)]
    rows += [(200 + k, t.upper()) for k, t in enumerate(base[:4])] + [(300, base[0]), (300, base[0]), (None, base[1]), (None, None)]
    rows += [(400 + k, base[5][: 300 + k] + words(rng, 30) + base[6][-900:]) for k in range(5)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return mixed()


def counted(items):
    return sorted(items, key=repr)


def test_characters_split_alike():
    """Every character that the fast path takes is split as the library splits it."""
    ids, n = bpe.ByteIds(bpe.read_tokenizer(BYTE)), bpe.WordCounts(bpe.read_tokenizer(WORD))
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    texts = [f"ab{c}{c}cd {c}e  {c} '{c}9" for c in chars if bpe._PLAIN.fullmatch(c)]
    assert len(texts) > 500
    assert list(ids.pieces(texts)) == [np.array(x.ids, "<u2").tobytes() for x in ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert list(n.pieces(texts)) == [len(x.ids) for x in n.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert len(n.fixed) > 10_000


def test_memo_bound_changes_nothing(monkeypatch):
    texts = [t or "" for _, t in mixed()]
    want = list(bpe.ByteIds(bpe.read_tokenizer(BYTE)).pieces(texts))
    monkeypatch.setattr(bpe, "MEMO", 10)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1000)
    assert list(bpe.ByteIds(bpe.read_tokenizer(BYTE)).pieces(texts)) == want


def test_workers_drop_what_other_stages_kept(spark):
    """An encoder stays for stages that keep it, in the same worker, and goes with any other stage."""

    def look(parts):
        import pyarrow as pa

        bpe.encoder(bpe.ByteIds, source.value) if fill else None
        yield from (pa.RecordBatch.from_pydict({"n": [len(common.KEPT)]}) for _ in parts)

    source, one = spark.sparkContext.broadcast(bpe.read_tokenizer(BYTE)), spark.range(1).coalesce(1)
    for fill, keeps, want in [(True, True, 1), (False, False, 0), (False, True, 0)]:
        assert [r.n for r in one.mapInArrow(common.tidy(look, keeps=keeps), "n bigint").collect()] == [want]


def test_token_counts(spark, rows):
    tok = Tokenizer.from_file(WORD)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert counted(tuple(r) for r in token_counts.count_tokens(table(spark, rows), WORD).collect()) == counted(want)
    assert token_counts.count_tokens(table(spark, []), WORD).count() == 0


def test_packing(spark, rows):
    tok = Tokenizer.from_file(BYTE)
    unique = [(k, t) for k, (_, t) in enumerate(rows)]
    got = packing.pack_documents(table(spark, unique).repartition(3), BYTE).toPandas()
    for k, t in unique:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in got[got.doc_id == k].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at: at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = 0
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
        padding += 0 if (n := int(s.length.sum())) & (n - 1) == 0 else 1024 - n
    assert padding < 0.01 * got.length.sum()
    assert packing.pack_documents(table(spark, []), BYTE).count() == 0
    for n in range(1, 5000, 7):
        assert sum(packing.cut(n, 1024, 1 / 128)) == n


def test_records(spark, rows):
    tok = Tokenizer.from_file(BYTE)
    path = scratch_path(spark, "test-records")
    records.write_records(table(spark, rows), path, BYTE)
    got = records.read_index(spark, path).orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    shuffled = records.read_shuffled(spark, path, 3).collect()
    assert counted((r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in shuffled) == counted((w[0], w[3]) for w in want)
    assert [r.doc_id for r in shuffled] != [w[0] for w in want]
    data = records.frame(7, np.arange(5, dtype="<u2")) + b"\n"
    for k in range(len(data)):
        broken = bytearray(data)
        broken[k] ^= 4
        with pytest.raises(ValueError):
            records.read_frame(memoryview(bytes(broken)), 0)
    empty = scratch_path(spark, "test-records")
    records.write_records(table(spark, []), empty, BYTE)
    assert records.read_index(spark, empty).count() == 0


def test_starts_follow_the_number_of_the_file(spark):
    names = [f"part-{n}-e95db1e0-c{c}.txt" for n, c in (("00000", "000"), ("09999", "000"), ("10000", "000"), ("10000", "999"), ("10000", "1000"), ("10001", "000"), ("99999", "000"), ("100000", "000"), ("100001", "000"))]
    frames = [(name, k, before, n) for k, name in enumerate(names) for before, n in ((0, k + 1), (k + 1, 10))]
    found = records.with_starts(spark.createDataFrame(frames, "file string, k int, before bigint, n_tokens bigint")).collect()
    want, start = [], 0
    for name, _, before, n in frames:
        want.append((name, before, start))
        start += n
    assert counted((r.file, r.before, r.start) for r in found) == counted(want)


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups(spark, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), keep is None or i == keep if i is not None else keep is None, hashlib.sha256(norm(t).encode()).hexdigest()))
    for capacity in (4096, 1):
        got = [tuple(r) for r in exact_index.exact_groups(table(spark, rows), capacity=capacity).collect()]
        assert counted((*r[:3], bool(r[3]), r[4]) for r in got) == counted((*w[:3], bool(w[3]), w[4]) for w in want)
    assert exact_index.exact_groups(table(spark, [])).count() == 0
    kept = exact_index.drop_copies(table(spark, rows))
    assert kept.columns == table(spark, []).columns
    assert counted(norm(r.text) for r in kept.collect()) == counted(groups)


def test_sharding(spark, rows):
    got = sharding.shard_documents(table(spark, rows), 4).collect()
    assert counted((r.doc_id, r.size, r.text_crc32) for r in got) == counted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    sizes, of = {}, {}
    for r in got:
        of.setdefault(r.text_crc32, set()).add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in of.values())
    for k in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    # the smallest capacity over the groups in order of their hashes, by brute force
    groups = {}
    for _, t in rows:
        key = hashlib.sha256((t or "").encode()).digest()
        groups[key] = groups.get(key, 0) + len((t or "").encode()) + 1
    ordered = [groups[k] for k in sorted(groups)]

    def needed(c):
        n, room = 0, 0
        for g in ordered:
            if g > room:
                n, room = n + 1, c
            room -= g
        return n

    lo, hi = max(ordered), sum(ordered)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if needed(mid) <= 4 else (mid + 1, hi)
    assert max(sizes.values()) == lo
    assert sharding.shard_documents(table(spark, []), 4).count() == 0


def shingles(t):
    w = [x for x in norm(t).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k: k + 5]) for k in range(len(w) - 4)}


def edited(rng, text, share):
    w = text.split(" ")
    for k in rng.sample(range(len(w)), int(share * len(w))):
        w[k] = "new" + str(rng.randint(0, 99))
    return " ".join(w)


@pytest.mark.parametrize("small", [64, 2])
def test_near_duplicates(spark, rows, monkeypatch, small):
    """small=2: nearly all unresolved members take the way of hot groups."""
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    rng = random.Random(8)
    base = words(rng, 300)
    docs = rows + [(1000 + k, edited(rng, base, rng.choice((0.005, 0.012, 0.02, 0.03)))) for k in range(40)]
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1:]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = counted((i, len(s), None if i is None else find(i)) for i, s in sets)
    got = near_dup.near_duplicates(table(spark, docs)).collect()
    assert counted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if small == 64:
        assert near_dup.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    pairs = [(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (20, 5), (30, 20), (30, 31)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {3: 3, 4: 3, 5: 3, 20: 3, 30: 3, 31: 3, 8: 8, 9: 8}


@pytest.mark.parametrize("hot", [2048, 1])
@pytest.mark.parametrize("first", [False, True])
def test_repeats(spark, monkeypatch, hot, first):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = random.Random(3)
    passage, other = words(rng, 120), words(rng, 60)
    docs = [(k, words(rng, 40) + passage[rng.randint(0, 99): 500 + rng.randint(0, 99)] + words(rng, 30)) for k in range(12)]
    docs += [(20, other * 3), (21, other), (22, "z" * 900), (23, "z" * 450), (24, "short"), (25, None), (26, ""), (27, docs[0][1]), (27, docs[0][1]), (None, passage)]
    n = 200
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    data = [(docs[k][1] or "").encode() for k in range(len(docs))]
    seen = {}
    for k in order:
        for at in range(len(data[k]) - n + 1):
            seen.setdefault(data[k][at: at + n], []).append((k, at))
    gone = [np.zeros(len(d), dtype=bool) for d in data]
    for places in seen.values():
        for k, at in places[1:] if first else places if len(places) > 1 else []:
            gone[k][at: at + n] = True
    want = []
    for k, d in enumerate(data):
        kept = np.frombuffer(d, np.uint8)[~gone[k]].tobytes()
        want.append((docs[k][0], len(d), int(gone[k].sum()), int((np.diff(np.concatenate(([0], gone[k].astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:5] for r in repeats.remove_repeats(table(spark, docs), keep_first=first).collect()]
    if first:  # of rows equal in id and text, any may count as the first
        got, want = ([w for w in x if w[0] not in (0, 27)] for x in (got, want))
    assert counted(got) == counted(want)
    if hot == 1 and not first:
        assert repeats.remove_repeats(table(spark, [])).count() == 0


def test_decontamination(spark, rows):
    rng = random.Random(11)
    items = [(k, words(rng, 16 + 3 * k)) for k in range(6)] + [(10, "only five words stand here"), (11, None), (12, ""), (None, words(rng, 20))]
    text = {i: t for i, t in items}

    def changed(t, at):
        w = t.split(" ")
        for k in at:
            w[k] = "other"
        return " ".join(w)

    docs = [(1, words(rng, 50) + " " + text[0] + " " + words(rng, 50)), (2, changed(text[3], (4, 9))), (3, "".join(c.upper() if c.isascii() else c for c in text[5]) + ". " + text[4]), (4, words(rng, 5000)),
            (5, "x Only five, words STAND here y"), (6, text[2][:30]), (7, None), (8, ""), (1, words(rng, 20))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, tuple(r.item_ids), r.contaminated) for r in decontam.decontaminate(table(spark, docs), bench).collect()}
    want = {(1, (0,), True), (2, (3,), True), (3, (4, 5), True), (4, (), False), (5, (10,), True), (6, (), False), (7, (), False), (8, (), False)}
    assert got == want
    assert decontam.decontaminate(table(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(table(spark, docs), bench.limit(0)).collect())
    assert counted(r.doc_id for r in decontam.keep_uncontaminated(table(spark, docs), bench).collect()) == [4, 6, 7, 8]


def test_contaminated_null_ids_leave_others(spark):
    """A row with a null id answers for its own text alone; a repeated id still shares a result."""
    rng = random.Random(13)
    items = [(k, words(rng, 20)) for k in range(2)]
    docs = [(None, words(rng, 30)), (None, "x " + items[0][1]), (None, None), (None, ""), (None, items[1][1] + " y"), (None, "x " + items[0][1]), (5, words(rng, 30)), (6, items[1][1]), (7, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontam.keep_uncontaminated(table(spark, docs), bench)
    assert kept.columns == table(spark, []).columns
    assert counted((r.doc_id, r.text) for r in kept.collect()) == counted(docs[k] for k in (0, 2, 3, 6, 8))
    got = [(r.doc_id, r.contaminated, tuple(r.item_ids)) for r in decontam.decontaminate(table(spark, docs), bench).collect()]
    assert counted(got) == counted([(None, False, ())] * 3 + [(None, True, (0,))] * 2 + [(None, True, (1,)), (5, False, ()), (6, True, (1,)), (7, False, ())])


def test_masks_ignore_any_two_errors():
    from itertools import combinations

    for pair in combinations(range(decontam.SPAN), decontam.ERRORS):
        assert any(not set(pair) & set(kept) for kept in decontam.MASKS)


@pytest.mark.parametrize(("overlap", "similarity"), [(13, 0.8), (7, 0.8), (20, 0.8), (13, 0.6), (26, 0.7)])
def test_overlaps_of_any_length(spark, overlap, similarity):
    """Items of 1 to 30 words, with as many substitutions as verification allows and one more, against all diagonals."""
    rng = random.Random(overlap)
    items = [(n, [f"w{n}x{k}" for k in range(n)]) for n in [*range(1, 14), 17, 30]]
    docs, want = [], set()
    for n, item in items:
        for errors in range(n):
            for _ in range(3):
                found = list(item)
                for k in rng.sample(range(n), errors):
                    found[k] = "other"
                doc = ["before"] * rng.randint(0, 3) + found + ["after"] * 2
                docs.append((len(docs), doc))
    for i, doc in docs:
        for n, item in items:
            need = min(n, overlap)
            sums = [sum(doc[d + k + j] == item[k + j] for j in range(need)) for d in range(-n, len(doc)) for k in range(n - need + 1) if 0 <= d + k and d + k + need <= len(doc)]
            if sums and max(sums) >= similarity * need:
                want.add((i, n, max(sums)))
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items], "item_id bigint, text string")
    got = decontam.find_overlaps(table(spark, [(i, " ".join(doc)) for i, doc in docs]), bench, overlap, similarity).collect()
    assert {(r.doc_id, r.item_id, r.n_equal) for r in got} == want and len(got) == len(want)


def test_masks_ignore_what_a_stretch_allows():
    from itertools import combinations

    for length in range(1, 40):
        for similarity in (0.5, 0.8, 0.9, 1.0):
            span, errors = decontam.seed(length, similarity)
            for pattern in combinations(range(span), errors) if span <= 13 else ():
                assert any(not set(pattern) & set(kept) for kept in decontam.masks_for(span, errors))
    for overlap, similarity in ((0, 0.8), (13, 0.0), (13, 1.1)):
        with pytest.raises(ValueError):
            decontam.find_overlaps(None, None, overlap, similarity)


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["grrk", "blargh"]
    docs = [(k, words(rng, 40) + (f" {bad[k % 2]} " + words(rng, 20) if k % 4 == 0 else "")) for k in range(400)] + [(900, None), (901, ""), (0, None)]
    labels = spark.createDataFrame([(k, int(k % 8 == 0), int(k % 4 == 0)) for k in range(300)] + [(399, None, 0), (None, 0, 1)], "doc_id bigint, junk int, toxic int")
    got = toxicity.classify(table(spark, docs), labels, ["junk", "toxic"], "toxic").collect()
    assert len(got) == len(docs)
    wrong = [r.doc_id for r in got if r.doc_id not in (0, 900, 901) and r.rejected != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 4
    assert not any(r.rejected for r in got if r.doc_id in (900, 901))
    assert not any(r.rejected for r in toxicity.classify(table(spark, docs), labels.limit(0), ["junk", "toxic"], "toxic").collect())
    clean = toxicity.keep_clean(table(spark, docs), labels, ["junk", "toxic"], "toxic")
    assert clean.columns == table(spark, []).columns and clean.count() == sum(not r.rejected for r in got)
    assert toxicity.classify(table(spark, []), labels, ["junk", "toxic"], "toxic").count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    odd = table(spark, [(1, None), (2, ""), (3, "123 ²½ !?"), (None, "words of a text"), (4, "words of a text")])
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en")}
    assert langid.identify(table(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}
