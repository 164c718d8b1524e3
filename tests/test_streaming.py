"""Structured Streaming ingest: several micro-batches, restart from the checkpoint."""

import os

import pytest

from canlens.operators.filters import Pred
from canlens.sources.dbc import load_dbc
from canlens.sources.traces import read_trace
from canlens.streaming.ingest import run_trace_stream_once
from helpers import write

DBC = 'BO_ 256 A: 2 N\n SG_ V : 0|16@1+ (0.5,0) [0|0] "" N\n'


def test_stream_batches_and_restart(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    for k in range(4):
        write(src, f"t{k}.csv", "".join(f"{k}.{i:03d},0,100,2,{i:02X} 00\n" for i in range(50)) + "bad,line\n")
    dbc = load_dbc(spark, write(tmp_path, "d.dbc", DBC))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    res, progress = run_trace_stream_once(spark, str(src / "*.csv"), "csv", out, ckpt, dbc=dbc,
                                          max_files_per_trigger=1)
    assert len(progress) == 4 and all(p["files"] == 1 and p["rows_written"] == 50 for p in progress)
    assert all((p["lines"], p["scanned"], p["matched"], p["rejected"]) == (51, 50, 50, 1) for p in progress)  # 50 frames + 1 bad line per file
    assert sum(p["bytes"] for p in progress) == sum(f.stat().st_size for f in src.glob("*.csv"))
    lost = spark.read.parquet(out + "-rejected").collect()
    assert sorted((r.trace_id.split("/")[-1], r.line_no, r.text) for r in lost) == [(f"t{k}.csv", 51, "bad,line") for k in range(4)]
    got = sorted((r.trace_id.split("/")[-1], r.ordinal, r.value) for r in res.collect())
    batch = read_trace(spark, str(src / "*.csv"), mode="tolerant")
    want = sorted((r.trace_id.split("/")[-1], r.ordinal, r.ordinal * 0.5) for r in batch.collect())
    assert got == want
    # A restart on the same checkpoint reprocesses nothing and leaves the sink unchanged.
    res2, progress2 = run_trace_stream_once(spark, str(src / "*.csv"), "csv", out, ckpt, dbc=dbc)
    assert progress2 == [] and res2.count() == len(want)
    # A new file is picked up on the next run.
    write(src, "t9.csv", "9.5,1,100,2,02 00\n")
    res3, progress3 = run_trace_stream_once(spark, str(src / "*.csv"), "csv", out, ckpt, dbc=dbc)
    assert [p["rows_written"] for p in progress3] == [1] and res3.count() == len(want) + 1


def test_stream_of_split_files(spark, tmp_path):
    """Files of many splits: ordinals and line numbers stay dense, the text is read once, a raw filter is counted."""
    src = tmp_path / "in"
    os.makedirs(src)
    n = 4000
    write(src, "long.csv", "timestamp,channel,can_id,dlc,payload,frame_type\n" + "".join("bad,line\n" if i % 1000 == 7 else f"{i}.5,{i % 3},{i % 5:X},1,{i % 256:02X}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = str(tmp_path / "out")
        res, (p,) = run_trace_stream_once(spark, str(src / "*.csv"), "csv", out, str(tmp_path / "ckpt"), raw_filter=Pred("channel", "eq", 1))
        want = [i for i in range(n) if i % 1000 != 7]
        assert sorted((r.ordinal, r.timestamp_ns) for r in res.collect()) == [(k, i * 10**9 + 500_000_000) for k, i in enumerate(want) if i % 3 == 1]
        assert (p["scanned"], p["matched"], p["rejected"], p["lines"]) == (len(want), sum(i % 3 == 1 for i in want), 4, n + 1)
        assert sorted(r.line_no for r in spark.read.parquet(out + "-rejected").collect()) == [9 + 1000 * k for k in range(4)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strict_stream_ends(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    write(src, "a.csv", "1.0,0,1,1,00\n\nworse\n")
    with pytest.raises(Exception, match="worse"):
        run_trace_stream_once(spark, str(src / "*.csv"), "csv", str(tmp_path / "out"), str(tmp_path / "ckpt"), mode="strict")


def test_metrics_arrive_live(spark, tmp_path):
    """Each batch's metrics reach the callback while the stream runs."""
    src = tmp_path / "in"
    os.makedirs(src)
    for k in range(3):
        write(src, f"t{k}.csv", f"{k}.0,0,1,1,00\n" * (k + 1))
    seen = []
    run_trace_stream_once(spark, str(src / "*.csv"), "csv", str(tmp_path / "out"), str(tmp_path / "ckpt"), max_files_per_trigger=1, on_batch=lambda b, m: seen.append((b, m["scanned"])))
    assert [b for b, _ in seen] == [0, 1, 2] and sorted(n for _, n in seen) == [1, 2, 3]
