"""Text trace readers: formats, strict/tolerant, ordinals, metadata (unit tier)."""

import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from canlens.errors import TraceParseError, UnsupportedFormat
from canlens.sources import traces
from canlens.sources.fixtures import write_text_trace
from canlens.sources.traces import UNSUPPORTED_FORMATS, bad_lines, classify_paths, discover_traces, flag_lines, format_of, parse_lines, read_trace, scan_stats, trace_metadata
from helpers import rows, write


def test_format_by_extension():
    assert format_of("a/b/trace.LOG") == "candump"
    assert format_of("x.candump") == "candump"
    assert format_of("x.txt") == "candump"
    assert format_of("x.Csv") == "csv"
    assert format_of("x.asc") == "asc"
    for ext, name in [(".blf", "BLF"), (".mf4", "MF4"), (".MDF4", "MF4"), (".trc", "TRC")]:
        with pytest.raises(UnsupportedFormat) as e:
            format_of("x" + ext)
        assert e.value.format_name == name
    with pytest.raises(UnsupportedFormat):
        format_of("x.bin")


def test_candump_one_row(spark, tmp_path):
    p = write(tmp_path, "t.log", "(0.001) can0 123#1122\n")
    df = read_trace(spark, p)
    r = df.collect()[0]
    assert (r.timestamp_ns, r.channel, r.can_id, r.dlc, r.frame_type, bytes(r.payload)) == \
        (1000000, 0, 0x123, 2, 0, b"\x11\x22")
    assert r.ordinal == 0


def test_candump_channel_rule_and_rejects(spark, tmp_path):
    text = "(1.5) vcan1 7FF#\n(2) can10 1#00\n(3) c1 2#00\n(4) can0 20000000#00\n(5) can0 1#0\n"
    p = write(tmp_path, "t.log", text)
    df = read_trace(spark, p, mode="tolerant")
    got = rows(df, "ordinal", "timestamp_ns", "channel", "can_id", "dlc")
    # can10 → last digit 0; 'c1' is too short → 0; id > 0x1FFFFFFF and odd hex run rejected
    assert got == [(0, 1500000000, 1, 0x7FF, 0), (1, 2000000000, 0, 1, 1), (2, 3000000000, 0, 2, 1)]


def test_csv_header_fd_and_dlc_ignored(spark, tmp_path):
    text = ("timestamp,channel,can_id,dlc,payload,frame_type\n"
            "0.001,1,123,8,0A BC 00,CAN\n"
            "TIMESTAMP,x\n"
            "0.002,257,7FF,0,FF,fd\n"
            "0.003,2,1,1,,\n")
    df = read_trace(spark, write(tmp_path, "t.csv", text))
    got = rows(df, "ordinal", "timestamp_ns", "channel", "can_id", "dlc", "frame_type")
    assert got == [(0, 1000000, 1, 0x123, 3, 0), (1, 2000000, 1, 0x7FF, 1, 1), (2, 3000000, 2, 1, 0, 0)]


def test_csv_strict_error_line(spark, tmp_path):
    p = write(tmp_path, "t.csv", "timestamp,channel,can_id,dlc,payload\nbad,line\n")
    with pytest.raises(TraceParseError) as e:
        read_trace(spark, p)
    assert e.value.line == 2


def test_csv_tolerant(spark, tmp_path):
    text = "0.001,0,100,1,01\n0.002,zz,100,1,02\n0.003,1,101,2,03 04,FD\n"
    df = read_trace(spark, write(tmp_path, "t.csv", text), mode="tolerant")
    got = rows(df, "ordinal", "can_id", "frame_type")
    assert got == [(0, 0x100, 0), (1, 0x101, 1)]
    bl = bad_lines(spark, write(tmp_path, "u.csv", text)).collect()
    assert [(r.line_no, r.text) for r in bl] == [(2, "0.002,zz,100,1,02")]


def test_fd_payload_64_bytes(spark, tmp_path):
    payload = " ".join(f"{i:02X}" for i in range(64))
    df = read_trace(spark, write(tmp_path, "t.csv", f"0.5,0,18DAF110,64,{payload},FD\n"))
    r = df.collect()[0]
    assert r.dlc == 64 and len(r.payload) == 64 and r.payload[-1] == 0x3F and r.frame_type == 1


def test_payload_token_rules(spark, tmp_path):
    # an empty token between two blanks is one zero byte; 65 tokens are too many
    text = "1,0,1,0,A  B\n2,0,2,0,0A0B0C\n3,0,3,0," + " ".join(["00"] * 65) + "\n4,0,4,0,ABC\n"
    df = read_trace(spark, write(tmp_path, "t.csv", text), mode="tolerant")
    got = [(r.can_id, bytes(r.payload)) for r in df.orderBy("ordinal").collect()]
    assert got == [(1, b"\x0a\x00\x0b"), (2, b"\x0a\x0b\x0c")]


ASC = """date Fri Aug 9 06:30:00.000 am 2019
base hex  timestamps absolute
// recorded on the test track
Begin Triggerblock Fri Aug 9 06:30:00.000 am 2019
   0.000000 Start of measurement
   0.125000 LIN 2 Rx 5C 77
   0.250000 7  0C0FFEEx        Tx   d 3 9E 41
   0.375000 4  2D              Rx   d 5 F0 E1 D2 C3 B4  Length = 0 BitCount = 0
   0.500000 CANFD   6 Tx        6A1  1 0 d 10 21 32 43 54 65 76 87 98 A9 BA
   2.750000 12 1A2B3C4x        Rx   d 2 6B 5A
End TriggerBlock
"""


def test_asc_mixed_bus(spark, tmp_path):
    df = read_trace(spark, write(tmp_path, "t.asc", ASC))
    got = rows(df, "ordinal", "can_id", "frame_type", "channel", "dlc")
    assert got == [(0, 0x0C0FFEE, 0, 7, 3), (1, 0x2D, 0, 4, 5), (2, 0x6A1, 1, 6, 10), (3, 0x1A2B3C4, 0, 12, 2)]
    # missing bytes are zero-filled up to the declared length
    p = {r.ordinal: bytes(r.payload) for r in df.collect()}
    assert p[0] == b"\x9e\x41\x00"
    md = trace_metadata(read_trace(spark, write(tmp_path, "u.asc", ASC), keep_source=True)).collect()[0]
    assert (md.event_count, md.start_timestamp_ns, md.end_timestamp_ns, md.source_format) == \
        (4, 250000000, 2750000000, "asc")


def test_asc_error_frame_is_strict_error(spark, tmp_path):
    p = write(tmp_path, "t.asc", "0.1 1 ErrorFrame\n0.2 1 100 Rx d 1 01\n")
    with pytest.raises(TraceParseError) as e:
        read_trace(spark, p)
    assert e.value.line == 1


def test_several_files_each_own_ordinals(spark, tmp_path):
    a = write(tmp_path, "a.log", "(1.0) can0 1#01\n\n(2.0) can0 2#02\n")
    b = write(tmp_path, "b.csv", "5.0,0,3,1,03\n")
    df = read_trace(spark, [a, b])
    got = sorted((r.trace_id.split("/")[-1], r.ordinal, r.can_id) for r in df.collect())
    assert got == [("a.log", 0, 1), ("a.log", 1, 2), ("b.csv", 0, 3)]


def test_ordinals_dense_across_many_splits(spark, tmp_path):
    """Several files, each read as many splits: ordinals follow file order exactly."""
    n = 30000
    lines = []
    for i in range(n):
        lines.append(f"{i}.5,{i % 3},{i % 2048:X},1,{i % 256:02X}")
        if i % 7 == 0:
            lines.append("timestamp,channel,can_id,dlc,payload")  # skipped
        if i % 11 == 0:
            lines.append("broken")  # bad line, dropped in tolerant mode
    p1 = write(tmp_path, "one.csv", "\n".join(lines) + "\n")
    p2 = write(tmp_path, "two.csv", "\n".join(lines[: len(lines) // 2]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        df = read_trace(spark, [p1, p2], mode="tolerant")
        got = df.select("trace_id", "ordinal", "timestamp_ns").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by = {}
    for r in got:
        by.setdefault(r.trace_id.split("/")[-1], []).append((r.ordinal, r.timestamp_ns))
    one = sorted(by["one.csv"])
    assert [o for o, _ in one] == list(range(n))
    assert all(ts == (i * 10**9 + 5 * 10**8) for i, (_, ts) in enumerate(one))
    two = sorted(by["two.csv"])
    assert [o for o, _ in two] == list(range(len(two)))


def test_discover(spark, tmp_path):
    write(tmp_path, "a.asc", "x\n")
    write(tmp_path, "b.dbc", "x\n")
    write(tmp_path, "c.bin", "x\n")
    got = [r.path.split("/")[-1] for r in discover_traces(spark, str(tmp_path)).collect()]
    assert got == ["a.asc", "b.dbc"]


def test_empty_and_header_only(spark, tmp_path):
    for name, text in [("h.csv", "timestamp,channel,can_id,dlc,payload\n"), ("e.csv", "")]:
        p = write(tmp_path, name, text)
        assert read_trace(spark, p).count() == 0
        assert bad_lines(spark, p).count() == 0


def test_path_key_fallback(spark, tmp_path, monkeypatch):
    """The split table keyed by path (used when two paths share a hash) numbers the same."""
    from canlens.sources import lines

    a = write(tmp_path, "a.csv", "".join(f"{i}.0,0,1,1,00\n" for i in range(7)) + "bad\n1.5,0,2,1,00\n")
    b = write(tmp_path, "b.csv", "9.0,0,3,1,00\n")
    want = sorted((r.trace_id, r.ordinal, r.can_id) for r in read_trace(spark, [a, b], mode="tolerant").collect())
    monkeypatch.setattr(lines, "USE_COMPACT_SPLIT_KEY", False)
    got = sorted((r.trace_id, r.ordinal, r.can_id) for r in read_trace(spark, [a, b], mode="tolerant").collect())
    assert got == want and [o for t, o, _ in got if t.endswith("a.csv")] == list(range(8))
    bl = [(r.line_no, r.text) for r in bad_lines(spark, a).collect()]
    assert bl == [(8, "bad")]


def test_split_changes_between_planning_and_execution_keep_every_frame(spark, tmp_path):
    """Byte ranges are pinned: new split sizes or parallelism can't lose or shift frames, and nothing is copied."""
    n = 20_000
    lines = ["timestamp,channel,can_id,dlc,payload,frame_type"] + [f"{i / 1000:.3f},1,{i % 2000:X},2,0A 0B,CAN" for i in range(n)]
    path = write(tmp_path, "splits.csv", "\n".join(lines) + "\n")
    size, cores = "spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism"
    before = {k: spark.conf.get(k, None) for k in (size, cores)}
    try:
        for first, then in ((("131072", "4"), ("200000", "3")), (("300000", "3"), ("65536", "8"))):
            spark.conf.set(size, first[0])
            spark.conf.set(cores, first[1])
            frames = read_trace(spark, path)
            assert "Scan text" in frames._jdf.queryExecution().executedPlan().toString()
            spark.conf.set(size, then[0])
            spark.conf.set(cores, then[1])
            got = [(r.ordinal, r.timestamp_ns) for r in frames.orderBy("ordinal").collect()]
            assert [o for o, _ in got] == list(range(n))
            assert [t for _, t in got] == sorted(t for _, t in got)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_classify_paths_as_format_of(spark):
    paths = ["a/b.c/t.LOG", "t.candump", "x.Csv/", "x.asc", "x.blf", "d/x.TRC", "x.bin", "noext", ".csv", "..csv", ".a.csv", "a.b/c", "t.csv.gz", "", None]
    got = classify_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    for r in got:
        try:
            want = (format_of(r.path or ""), None)
        except UnsupportedFormat as e:
            want = (None, UNSUPPORTED_FORMATS.get(os.path.splitext(e.path)[1].lower()))
        assert (r.source_format, r.known_format) == want, r.path


def test_metadata_of_empty_traces(spark, tmp_path):
    write(tmp_path, "a.csv", "timestamp,channel,can_id,dlc,payload\n0.5,0,7A,1,03\n")
    write(tmp_path, "b.csv", "timestamp,channel,can_id,dlc,payload\n")
    write(tmp_path, "c.log", "\n")
    write(tmp_path, "d.log", "")  # of no bytes: no file scan has a row for it
    write(tmp_path, "e f+%41.log", "")
    files = discover_traces(spark, str(tmp_path))
    md = trace_metadata(read_trace(spark, [r.path for r in files.collect() if "+" not in r.path], keep_source=True), files)
    assert [r.path.split("/")[-1] for r in files.collect()] == ["a.csv", "b.csv", "c.log", "d.log", "e f+%41.log"]
    got = {r.trace_id[-5:]: (r.event_count, r.start_timestamp_ns, r.source_size_bytes, r.source_format) for r in md.collect()}
    assert got == {"a.csv": (1, 500_000_000, 51, "csv"), "b.csv": (0, None, 37, "csv"), "c.log": (0, None, 1, "candump"), "d.log": (0, None, 0, "candump"),
                   "1.log": (0, None, 0, "candump")}


def test_scan_stats(spark, tmp_path):
    """Bytes consumed are the file's, with and without a last line end and with carriage returns."""
    texts = {"a.csv": "1.0,0,1,1,00\r\nworse\n\n2.0,0,1,1,00", "b.csv": "timestamp,channel\n", "c.log": "(1.0) can0 1#00\n(2.0) can0 1#zz\n"}
    paths = [write(tmp_path, n, t) for n, t in texts.items()]
    got = {r.trace_id[-5:]: (r.lines, r.frames, r.rejected, r.bytes_consumed) for r in scan_stats(spark, paths).collect()}
    assert got == {"a.csv": (4, 2, 1, len(texts["a.csv"])), "b.csv": (1, 0, 0, len(texts["b.csv"])), "c.log": (2, 1, 1, len(texts["c.log"]))}
    assert [(r.line_no, r.text) for r in bad_lines(spark, paths[0]).collect()] == [(2, "worse")]


@pytest.mark.parametrize("fmt", ["csv", "candump"])
def test_plain_lines_parse_as_the_others(spark, monkeypatch, fmt):
    """The short way of plainly spelled lines gives what the full checks give, on lines near its limits."""
    rng = random.Random(7)
    data = ["", "00", "0a FF", "0aff", "0", "0a f", "GG", "00 " * 64, ("00 " * 64).strip(), ("7f " * 65).strip(), "11" * 64, "11" * 65]
    times = ["0.0", "1.5", "123456789.123456789", "1234567890.5", "1.1234567891", "1", ".5", "1e3", "-1.0", "0.000000001", "1704067200.000001"]
    ids = ["0", "7FF", "1fffffff", "20000000", "01FFFFFFF", "FFFFFFFF", "00000000012", "", "xyz", "1ABCDEF0"]
    if fmt == "csv":
        lines = [",".join([rng.choice(times), rng.choice(["0", "3", "255", "256", "999", "1000", "x", ""]), rng.choice(ids), rng.choice(["", "8", "x"]), rng.choice(data), rng.choice(["CAN", "FD", "fd", "", "FD,x"])]) for _ in range(1500)]
    else:
        lines = [f"({rng.choice(times)}) {rng.choice(['can0', 'can12', 'vcan3', 'can', 'c9', 'c-n0', 'slcan0x'])} {rng.choice(ids)}#{rng.choice(data)}" for _ in range(1500)]
    lines += [" " + lines[0] + "\t", lines[1] + "\r"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, value string")
    for options in ({}, {"exact_time": True}, {"full_channel": True}):
        short = sorted(map(repr, parse_lines(rows, fmt, **options).collect()))
        flags = sorted((r.k, r.is_record, r.is_frame) for r in flag_lines(rows, fmt).collect())
        with monkeypatch.context() as m:
            m.setattr(traces, "PLAIN", {})
            full = parse_lines(rows, fmt, **options).collect()
        keep = [r if r.is_frame else r.asDict() | dict.fromkeys(("timestamp_ns", "can_id", "dlc", "channel", "frame_type", "payload")) for r in full]
        assert [x for x in short if "is_frame=True" in x] == sorted(repr(r) for r in keep if not isinstance(r, dict))
        assert flags == sorted((r.k, r.is_record, r.is_frame) for r in full)
        assert 100 < sum(r.is_frame for r in full) < 1400


def test_full_channel(spark, tmp_path):
    p = write(tmp_path, "a.log", "".join(f"(1.0) {i} 1#00\n" for i in ("can10", "vcan7", "can", "can300", "x12y")))
    assert [r.channel for r in read_trace(spark, p, full_channel=True).orderBy("ordinal").collect()] == [10, 7, 0, 44, 0]
    assert [r.channel for r in read_trace(spark, p).orderBy("ordinal").collect()] == [0, 7, 0, 0, 0]


@pytest.mark.parametrize("parse", [flag_lines, parse_lines])
def test_asc_code_is_short_enough_to_be_compiled(spark, capsys, parse):
    """Generated methods over 8000 bytes are never compiled by the JIT; ASC lines took 11312 and 16981."""
    parse(spark.createDataFrame([("1.0 1 100x Rx d 1 05",)], "value string"), "asc").explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_asc_odd_lines(spark):
    """Kinds, cut lines and lengths of the steps that ASC lines take."""
    text = ["1.5 1 7FFx Rx d 2 0A b", " 2.0 canfd 3 Rx 1FFFFFFFX 1 0 9 2 01 02 03", "1.0 CANFD 3 Rx 100x 1 0 9 65 01", "1.0 x 100 Rx d 1 05", "1.0 1 100 Rx d 1", "1.0 1 20000000x Rx d 1 05", "9", "", "1.0 257 100 Rx d 0 GG"]
    got = {r.k: r for r in parse_lines(spark.createDataFrame(list(enumerate(text)), "k int, value string"), "asc").collect()}
    frames = [(k, r.timestamp_ns, r.can_id, r.dlc, r.channel, r.frame_type, bytes(r.payload).hex()) for k, r in sorted(got.items()) if r.is_frame]
    assert frames == [(0, 1500000000, 0x7FF, 2, 1, 0, "0a0b"), (1, 2000000000, 0x1FFFFFFF, 2, 3, 1, "0102"), (8, 1000000000, 0x100, 0, 1, 0, "")]
    assert [k for k, r in sorted(got.items()) if r.is_record and not r.is_frame] == [2, 4, 5]


def test_each_rendered_file_has_its_task(spark, tmp_path):
    """No task writes several traces; by hash of the bucket one of six tasks got three of them."""
    fr = spark.createDataFrame([("t", o, 1704067200 * 10**9, 1, 1, 0, 0, b"a") for o in range(60)],
                               "trace_id string, ordinal bigint, timestamp_ns bigint, can_id bigint, dlc int, channel int, frame_type int, payload binary")
    paths = glob.glob(write_text_trace(fr, str(tmp_path), "csv", files=6))
    assert len(paths) == 6 and len({os.path.basename(p).split("-")[1] for p in paths}) == 6
    assert sorted(r.ordinal for r in read_trace(spark, paths, fmt="csv").collect()) == sorted(list(range(10)) * 6)
