"""Integration tier: text file → query → rows, counts, context, lookups, exports, hooks."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from canlens.errors import QueryError
from canlens.operators import context, hooks
from canlens.operators.context import context_of, context_of_matches
from canlens.operators.filters import Pred, Rule, all_of, any_of, compile_raw, from_clauses, from_rules, negate
from canlens.operators.paging import centre_on, pan, shift_ordinal_window, zoom
from canlens.operators.session import TraceSession, open_session
from canlens.plans import query, sizing
from canlens.plans.query import early_stop_counts, run_query, summary_counts
from canlens.sinks import export as ex
from canlens.sources import store as st
from canlens.sources.dbc import load_dbc
from canlens.sources.traces import read_trace
from helpers import write

DBC = 'BO_ 291 Speed: 2 N\n SG_ V : 0|16@1+ (1,0) [0|65535] "kmh" N\nBO_ 1110 Other: 1 N\n SG_ W : 0|8@1+ (1,0) [0|255] "" N\n'


@pytest.fixture(scope="module")
def dbc(spark, tmp_path_factory):
    return load_dbc(spark, write(tmp_path_factory.mktemp("q"), "s.dbc", DBC))


def _ords(df):
    return sorted(r.ordinal for r in df.select("ordinal").collect())


def test_decode_and_export_flow(spark, dbc, tmp_path):
    p = write(tmp_path, "t.csv", "0.001,0,123,2,2A 00\n0.002,0,456,1,10\n0.003,0,123,2,05 00\n")
    fr = read_trace(spark, p)
    res = run_query(fr, can_id=0x123, dbc=dbc, decode=True)
    assert _ords(res) == [0, 2]
    assert sorted(s.value for r in res.collect() for s in r.signals) == [5.0, 42.0]
    c = summary_counts(fr, F.col("can_id") == 0x123).collect()[0]
    assert (c.scanned, c.matched) == (3, 2)


def test_combined_filters(spark, dbc, tmp_path):
    text = ("0.001,1,123,2,01 00\n"   # ts 1ms: fails time
            "0.002,1,123,2,05 00,FD\n"  # passes all
            "0.003,0,123,2,00 00\n"   # channel 0 and classic: fails OR
            "0.004,1,123,2,00 00\n")  # value 0: fails NOT value = 0
    fr = read_trace(spark, write(tmp_path, "t.csv", text))
    raw = all_of(Pred("timestamp_ns", "gt", 1_500_000), any_of(Pred("channel", "eq", 1), Pred("frame_type", "eq", "fd")))
    dec = all_of(Pred("message_name", "eq", "SPEED"), Pred("signal_value", "gt", 1), negate(Pred("signal_value", "eq", 0)))
    assert _ords(run_query(fr, raw_filter=raw, decoded_filter=dec, dbc=dbc)) == [1]
    assert _ords(run_query(fr, raw_filter=raw, decoded_filter=dec, dbc=dbc, keep_undecoded=True)) == [1]


def test_raw_before_decoded(spark, dbc, tmp_path):
    text = "0.001,0,123,2,0B 00\n0.002,0,456,1,FF\n0.003,0,123,2,01 00\n0.004,0,123,2,14 00\n"
    fr = read_trace(spark, write(tmp_path, "t.csv", text))
    got = run_query(fr, raw_filter=Pred("can_id", "eq", 0x123), decoded_filter=Pred("signal_value", "gt", 10), dbc=dbc)
    assert _ords(got) == [0, 3]


def test_first_and_max_matches(spark, tmp_path):
    fr = read_trace(spark, write(tmp_path, "t.csv", "".join(f"0.{i:03d},0,{0x100 + i % 2:X},1,00\n" for i in range(10))))
    assert _ords(run_query(fr, raw_filter=Pred("can_id", "eq", 0x101), first_only=True)) == [1]
    assert _ords(run_query(fr, raw_filter=Pred("can_id", "eq", 0x101), max_matches=3)) == [1, 3, 5]
    assert _ords(run_query(fr, max_matches=0)) == []
    with pytest.raises(QueryError):
        run_query(fr, ordinal_start=5, ordinal_end=2)


def test_context(spark, tmp_path):
    """Windows at the middle and both ends of a trace of 30 frames, and of overlapping matches."""
    fr = read_trace(spark, write(tmp_path, "t.csv", "".join(f"{k}.5,1,{0x40 + k % 7:X},1,{k:02X}\n" for k in range(30))))

    def near(o, before, after, **kw):
        return [(r.ordinal, r.rel_pos) for r in context_of(fr, o, before, after, **kw).orderBy("ordinal").collect()]

    assert near(17, 4, 2) == [(o, o - 17) for o in range(13, 20)]
    assert near(1, 5, 0) == [(0, -1), (1, 0)] and near(29, 1, 90) == [(28, -1), (29, 0)]
    assert near(30, 8, 8) == [] and near(17, 4, 2, enabled=False) == []
    m = run_query(fr, raw_filter=all_of(Pred("can_id", "eq", 0x42), Pred("timestamp_ns", "lt", 20 * 10**9)))
    want = sorted((o, o + d) for o in (2, 9, 16) for d in range(-3, 5) if o + d >= 0)
    assert sorted((r.match_ordinal, r.ordinal) for r in context_of_matches(fr, m, 3, 4).collect()) == want
    assert context_of_matches(fr, m.filter("false"), 1, 1).count() == 0


def test_store_and_lookups(spark, tmp_path):
    text = "".join(f"0.00{i + 1},0,{c:X},1,00\n" for i, c in enumerate([0x123, 0x1, 0x123, 0x2, 0x123]))
    fr = read_trace(spark, write(tmp_path, "t.csv", text))
    s = st.read_store(spark, st.save_trace(fr, str(tmp_path / "store"), chunk_size=2))
    back = s.drop("chunk_id")
    assert back.exceptAll(fr).count() == 0 and fr.exceptAll(back).count() == 0
    r = st.lookup_time_range(s, 2_000_000, 4_000_000).collect()[0]
    assert (r.first_ordinal, r.last_ordinal, r.matched) == (1, 3, True)
    assert [x.ordinal for x in st.lookup_id(s, 0x123).collect()] == [0, 2, 4]
    assert st.lookup_ordinal(s, 3).count() == 1 and st.lookup_ordinal(s, 7).count() == 0
    chunks = st.build_chunk_summary(s, 2)
    assert sorted((c.chunk_id, c.event_count) for c in chunks.collect()) == [(0, 2), (1, 2), (2, 1)]
    total = st.store_summary(chunks).collect()[0]
    assert (total.event_count, total.start_timestamp_ns, total.end_timestamp_ns) == (5, 1_000_000, 5_000_000)
    assert _ords(st.store_range(s, 2_500_000, 3_500_000)) == [2]


def test_lookup_goldens(spark):
    rows = [("t", 3 + i, ts, 1, 0, 0, 0, b"") for i, ts in enumerate([70, 81, 333, 512, 640])]
    fr = spark.createDataFrame(rows, "trace_id string, ordinal bigint, timestamp_ns bigint, can_id bigint, "
                                     "dlc int, channel int, frame_type int, payload binary")
    r = st.lookup_time_range(fr, 75, 512).collect()[0]
    assert (r.first_ordinal, r.last_ordinal, r.matched) == (4, 6, True)
    r = st.lookup_time_range(fr, 640, 640).collect()[0]
    assert (r.first_ordinal, r.last_ordinal, r.matched) == (7, 7, True)
    r = st.lookup_time_range(fr, 82, 332).collect()[0]
    assert (r.first_ordinal, r.last_ordinal, r.matched) == (None, None, False)


def test_export_goldens(spark, tmp_path):
    """Ids in hex, payloads as blank-separated bytes, an empty payload, both frame types."""
    rows = [("t", 0, 7_500_000_001, 0x5C, 4, 0, 1, bytes.fromhex("00c07f10")), ("t", 1, 7_500_000_999, 0x1ABCDE0, 0, 13, 0, b""), ("t", 2, 8 * 10**9, 0x7, 2, 4, 0, b"\x3e\x01")]
    fr = spark.createDataFrame(rows, "trace_id string, ordinal bigint, timestamp_ns bigint, can_id bigint, "
                                     "dlc int, channel int, frame_type int, payload binary")
    assert ex.export_raw_csv(fr.coalesce(1), str(tmp_path / "raw")) == 3
    lines = "".join(open(p).read() for p in sorted((tmp_path / "raw").glob("part-*.csv"))).splitlines()
    assert lines[0] == "timestamp_ns,channel,can_id,dlc,payload,frame_type"
    assert [x.split(",")[:4] + [x.split(",")[5]] for x in lines[1:]] == [["7500000001", "0", "5C", "4", "FD"], ["7500000999", "13", "1ABCDE0", "0", "CAN"], ["8000000000", "4", "7", "2", "CAN"]]
    assert [x.split(",")[4].strip('"') for x in lines[1:]] == ["00 C0 7F 10", "", "3E 01"]
    long = spark.createDataFrame([(61, 0xB2, "Tide", "Level", 1e-7, "m"), (61, 0xB2, "Tide", "Moon", 1234567.0, ""), (62, 0xB3, "Wind", "Gust", -0.5, "kn")],
                                 "timestamp_ns bigint, can_id bigint, message_name string, signal_name string, "
                                 "value double, unit string")
    assert ex.export_decoded_csv(long.coalesce(1), str(tmp_path / "dec")) == 3
    lines = "".join(open(p).read() for p in sorted((tmp_path / "dec").glob("part-*.csv"))).splitlines()
    assert [x.split(",")[:4] for x in lines[1:]] == [["61", "B2", "Tide", "Level"], ["61", "B2", "Tide", "Moon"], ["62", "B3", "Wind", "Gust"]]
    assert [x.split(",")[4] for x in lines[1:]] == ["1E-07", "1.23457E+06", "-0.5"] and lines[3].endswith(",kn")


def test_format_g6_matches_c(spark):
    import random

    from canlens.functions.scalars import format_g6

    rnd = random.Random(5)
    vals = [0.0, 1.0, -1.0, 42.5, 1e-5, 123456.0, 1234567.0, 0.0001, 1e154, -2.5e-300, 100000.0, 999999.5]
    vals += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-8, 12) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for r in df.select("v", format_g6("v").alias("s")).collect():
        assert r.s == ("%.6G" % r.v), r.v


def test_hooks(spark, tmp_path):
    fr = read_trace(spark, write(tmp_path, "t.csv", "0.000001,2,123,3,01 02 03\n0.000002,1,124,1,00\n"))
    accept = lambda ts, cid, ch, dlc: (ts == 1000) & (cid == 0x123) & (ch == 2) & (dlc == 3)
    assert _ords(run_query(fr, frame_hook=hooks.frame_hook(accept))) == [0]
    assert _ords(run_query(fr, frame_hook=hooks.frame_hook(accept, enabled=False))) == [0, 1]

    def boom(ts, cid, ch, dlc):
        raise RuntimeError("hook exploded")

    with pytest.raises(Exception) as e:
        run_query(fr, frame_hook=hooks.frame_hook(boom)).collect()
    assert "hook exploded" in str(e.value)


def test_rules_and_clauses():
    t = from_rules([Rule("can_id", "eq", "1 | 2"), Rule("channel", "eq", "3 & -4"), Rule("can_id", "eq", "5|6&7")])
    # must 3, any (1 | 2), exclude 4; the mixed "5|6&7" stays one literal and is dropped as unparsable
    from canlens.operators.filters import And, Not, Or
    assert t == And((Pred("channel", "eq", 3), Or((Pred("can_id", "eq", 1), Pred("can_id", "eq", 2))),
                     Not((Pred("channel", "eq", 4),))))
    assert from_clauses() is None
    assert from_clauses([("can_id", "eq", 1)]) == Pred("can_id", "eq", 1)


def test_paging_helpers():
    assert shift_ordinal_window(2000, 2000, -3) == (0, 1999)
    assert shift_ordinal_window(0, 2000, 2) == (4000, 5999)
    assert zoom(100, 200, 0.5) == (125, 175)
    assert pan(0, 100, -0.5) == (0, 100)
    assert zoom(100, 200, 2) == (50, 250) and zoom(100, 200, 2, bounds=(90, 220)) == (90, 220)
    assert zoom(7, 7, 0.5) == (6, 8)  # at least 1 to each side
    assert zoom(0, 2**60 + 2, 0.5) == (2**59 + 1 - 2**58, 2**59 + 1 + 2**58)  # exact beyond 2**53
    assert centre_on(0, 100, 480, bounds=(0, 500)) == (430, 500)  # clipped, not shifted
    assert centre_on(0, 100, 1000, bounds=(0, 500)) == (500, 500)


def test_early_stop_counts(spark):
    rows = [(t, i, 0x10 + i % 3) for t, n in (("a", 10), ("b", 4), ("c", 2)) for i in range(n)]
    fr = spark.createDataFrame(rows, "trace_id string, ordinal bigint, can_id bigint")
    hit = compile_raw(Pred("can_id", "eq", 0x12))
    got = lambda *a: {r.trace_id: (r.scanned, r.matched) for r in early_stop_counts(fr, hit, *a).collect()}
    assert got(2) == {"a": (6, 2), "b": (4, 1), "c": (2, 0)}
    assert got(2, 4) == {"a": (5, 2)}
    assert got(0) == {"a": (0, 0), "b": (0, 0), "c": (0, 0)}


@pytest.mark.parametrize("bits", [16, 2])
def test_early_stop_by_ranges(spark, monkeypatch, bits):
    """Stops at every match of traces with matches in some ranges only; no task ranks a whole trace."""
    monkeypatch.setattr(query, "RANGE_BITS", bits)
    hits = {"a": {3, 4, 5, 17, 18, 40}, "b": {0, 59}, "c": set()}
    rows = [(t, i, i in hits[t]) for t in hits for i in range(60)]
    fr = spark.createDataFrame(rows, "trace_id string, ordinal bigint, hit boolean").repartition(5)
    for n in range(8):
        want = {t: (0 if not n else sorted(h)[n - 1] + 1 if len(h) >= n else 60, min(n, len(h))) for t, h in hits.items()}
        assert {r.trace_id: (r.scanned, r.matched) for r in early_stop_counts(fr, F.col("hit"), n).collect()} == want
    plan = early_stop_counts(fr, F.col("hit"), 1_000_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(trace_id" in plan and "_range" in plan.split("row_number")[1]


@pytest.mark.parametrize("bound", [200_000, 3])
def test_context_over_islands(spark, monkeypatch, bound):
    """Windows by exact bins and by the map of hashed bins, with overlaps and windows over bin ends, in many traces."""
    monkeypatch.setattr(context, "fits_broadcast", lambda df, max_rows=None: df.columns == ["trace_id", "bin", "covered"] and bound > 3)
    rng = random.Random(bound)
    fr = spark.createDataFrame([(f"t{k}", i) for k in range(70) for i in range(150)], "trace_id string, ordinal bigint").repartition(7)
    picked = {(f"t{k}", rng.randrange(150)) for k in range(0, 70, 2) for _ in range(4)}
    m = spark.createDataFrame(sorted(picked), "trace_id string, ordinal bigint")
    found = context_of_matches(fr, m, 4, 9)
    got = sorted((r.trace_id, r.match_ordinal, r.ordinal, r.rel_pos) for r in found.collect())
    assert got == sorted((t, o, c, c - o) for t, o in picked for c in range(max(0, o - 4), min(149, o + 9) + 1))
    bins = spark.createDataFrame([(t, (o + d) // 64) for t, o in picked for d in (-4, 9) if o + d >= 0], "trace_id string, bin bigint").distinct()
    exact = context.islands(m)
    kept = context._on_islands(fr, exact)
    assert {(r.trace_id, r.ordinal) for r in kept.collect()} >= picked
    if bound > 3:
        assert {(r.trace_id, r.ordinal) for r in kept.collect()} == picked
    else:
        near = {(r.trace_id, r.bin) for r in exact.collect()}
        assert {(r.trace_id, r.ordinal // 64) for r in kept.collect()} == near and bins.count() >= len(near)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_u64_literals(spark):
    fr = spark.createDataFrame([(0, 2**63 - 1), (1, 5)], "ordinal bigint, timestamp_ns bigint")
    want = {"lt": [0, 1], "le": [0, 1], "ne": [0, 1], "eq": [], "gt": [], "ge": []}
    assert {op: _ords(fr.filter(compile_raw(Pred("timestamp_ns", op, 2**63)))) for op in want} == want
    assert _ords(fr.filter(compile_raw(Pred("timestamp_ns", "gt", -(2**63) - 1)))) == [0, 1]


def test_session(spark, dbc, tmp_path):
    text = "0.001,0,123,2,0B 00\n0.002,0,999,1,FF\n0.003,1,123,2,01 00\n"
    s = TraceSession(read_trace(spark, write(tmp_path, "t.csv", text)), dbc, decode=True)
    assert _ords(s.filter_full(raw_filter=Pred("can_id", "eq", 0x123))) == [0, 2]
    assert _ords(s.refine(decoded_filter=Pred("signal_value", "gt", 5))) == [0]
    assert _ords(s.reset()) == [0, 1, 2]
    assert _ords(s.filter_full(decoded_filter=Pred("signal_value", "ge", 0))) == [0, 2]
    s.close()


def test_session_table(spark, dbc, tmp_path):
    """The base is a table with an owner: results read it, nothing is cached, another session reads it, the owner removes it."""
    p = write(tmp_path, "t.csv", "".join(f"{k}.0,0,{0x123 + k % 2:X},2,{k:02X} 00\n" for k in range(20)))
    s = TraceSession(read_trace(spark, p), dbc, decode=True, path=str(tmp_path / "kept"))
    os.remove(p)  # the source isn't needed again
    found = s.refine(raw_filter=Pred("can_id", "eq", 0x123))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "kept/rows" in plan and "InMemoryTableScan" not in plan and not s.base.is_cached
    other = open_session(spark, str(tmp_path / "kept"))
    assert _ords(other.filter_full(decoded_filter=Pred("signal_value", "gt", 9))) == [10, 12, 14, 16, 18]
    other.owned = False  # as in another application
    other.close()
    assert _ords(found) == list(range(0, 20, 2))
    s.close()
    assert not os.path.exists(tmp_path / "kept")


def test_callback_sink(spark, tmp_path):
    """K5: one call per match, on the executors (counted with an accumulator)."""
    fr = read_trace(spark, write(tmp_path, "t.csv", "".join(f"0.00{i},0,{0x100 + i % 2:X},1,00\n" for i in range(9))))
    acc = spark.sparkContext.accumulator(0)
    ex.for_each_match(run_query(fr, raw_filter=Pred("can_id", "eq", 0x101)), lambda row: acc.add(1))
    assert acc.value == 4


RETRY = """
import json, os, sys
from pyspark.sql import SparkSession, functions as F
sys.path.insert(0, sys.argv[1])
from canlens.sinks.export import for_each_batch
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2] + "/ckpt").getOrCreate()
spark.sparkContext.setCheckpointDir(sys.argv[2] + "/ckpt")
out = sys.argv[2]

def write(batch, partition, attempt):
    with open(f"{out}/staged-{partition}-{attempt}", "a") as f:
        f.write("".join(f"{x}\\n" for x in batch.column("id").to_pylist()))
    if partition == 1 and attempt == 0:
        raise RuntimeError("first attempt")
    return batch.num_rows

ledger = for_each_batch(spark.range(1000, numPartitions=4), write, lambda p, a: os.rename(f"{out}/staged-{p}-{a}", f"{out}/done-{p}"))
print(json.dumps([list(r) for r in ledger.orderBy("partition").collect()]))
"""


def test_callback_of_a_retried_task(tmp_path):
    """A task whose first attempt fails after writing counts once, and its rows are published once."""
    script = write(tmp_path, "retry.py", RETRY)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, script, root, str(tmp_path)], capture_output=True, text=True, timeout=180, env=env)
    ledger = json.loads(done.stdout.strip().splitlines()[-1])
    assert ledger == [[0, 0, 250, 250], [1, 1, 250, 250], [2, 0, 250, 250], [3, 0, 250, 250]]
    rows = [int(x) for p in range(4) for x in open(tmp_path / f"done-{p}")]
    assert sorted(rows) == list(range(1000)) and os.path.exists(tmp_path / "staged-1-0")


@pytest.mark.parametrize("traces", [1, 1000])
def test_store_files_have_the_target_size(spark, tmp_path, monkeypatch, traces):
    """Files within twice the target for one trace and for a thousand, one of which holds a third of all frames."""
    monkeypatch.setattr(st, "LEAST_ROWS", 1)
    n = 60_000
    trace = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(traces)))
    rows = spark.range(n).select(F.format_string("t%04d", trace).alias("trace_id"), F.col("id").alias("o"), (F.xxhash64("id") % 2000).alias("can_id"), F.lit(8).alias("dlc"),
                                 F.lit(0).alias("channel"), F.lit(0).alias("frame_type"), F.unhex(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16)).alias("payload"))
    ordinal = (F.row_number().over(Window.partitionBy("trace_id").orderBy("o")) - 1).cast("bigint")
    fr = rows.withColumn("ordinal", ordinal).withColumn("timestamp_ns", F.col("o") * 1000).select("trace_id", "ordinal", "timestamp_ns", "can_id", "dlc", "channel", "frame_type", "payload")
    target = 100_000
    path = st.save_trace(fr, str(tmp_path / "store"), target_bytes=target, id_bloom_filter=False)
    sizes = [os.path.getsize(p) for p in (tmp_path / "store").glob("part-*.parquet")]
    assert len(sizes) > 5 and all(target / 2 < x < 2 * target for x in sizes)
    back = st.read_store(spark, path).drop("chunk_id")
    assert back.exceptAll(fr).count() == 0 and back.count() == n
    spread = st.read_store(spark, path).groupBy(F.input_file_name().alias("f")).agg(F.min(F.struct("trace_id", "ordinal")).alias("a"), F.max(F.struct("trace_id", "ordinal")).alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(spread, spread[1:], strict=False))  # files don't overlap


def test_context_of_many_matches_is_not_broadcast(spark, monkeypatch, capsys):
    """Windows over the bound are joined by a shuffle, though the file they are generated from is small."""
    small = sizing.DEFAULT_MAX_BROADCAST_ROWS
    fr = spark.createDataFrame([(t, o, 10 * o) for t in ("x", "y") for o in range(40)] + [(None, 1, 2)], "trace_id string, ordinal bigint, can_id bigint")
    matches = fr.filter("ordinal % 8 = 1")
    want = sorted((t, m, o, o - m, 10 * o) for t in ("x", "y") for m in range(1, 40, 8) for o in range(max(0, m - 2), min(39, m + 3) + 1))
    for bound in (small, 4):  # two traces fit in either
        monkeypatch.setattr(context, "fits_broadcast", lambda df, n=bound: sizing.fits_broadcast(df, n))
        monkeypatch.setattr(context, "join_small", lambda a, b, on, n=bound: sizing.join_small(a, b, on, max_rows=n))
        found = context.context_of_matches(fr, matches, 2, 3)
        assert found.columns == ["trace_id", "ordinal", "can_id", "match_ordinal", "rel_pos"]
        assert sorted((r.trace_id, r.match_ordinal, r.ordinal, r.rel_pos, r.can_id) for r in found.collect()) == want
        found.explain()
        plan = capsys.readouterr().out
        assert ("SortMergeJoin" in plan) == (bound == 4)
