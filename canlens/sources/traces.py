"""Text trace ingest: candump, CSV and ASC files → the ``frames`` table.

``read_trace`` is a Spark job: ``spark.read.text`` over any number of files or globs,
one column expression per field (no Python per row), dense per-file ordinals (see
``lines.py``), and a strict/tolerant switch.  The text is read twice and never copied: a counting
pass, which only tells records from other lines and gives one row per split, and the reading pass.
Strict mode raises ``TraceParseError`` with the physical line number of the first bad line after the
counting pass, before any output is produced.

Lines spelled plainly (``PLAIN``: one pattern per format) are known to be frames, and their fields are
cut out without further checks; all other lines take the full checks, with the same results.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TraceParseError, UnsupportedFormat
from ..functions.scalars import (
    dec_mod_256,
    hex_tokens_to_hex,
    dec_to_long,
    hex_to_long,
    parse_payload,
    seconds_to_ns,
    valid_can_id,
    ws_trim,
)
from ..schema import FRAME_COLUMNS
from ..plans.sizing import join_small
from .lines import MAX_SPLIT_ROWS_COMPACT, SPLIT_KEYS, numbered, scan_lines, split_table

# Extension → format, and the recognised formats no reader exists for.
TEXT_FORMATS = {".log": "candump", ".candump": "candump", ".txt": "candump", ".csv": "csv", ".asc": "asc"}
UNSUPPORTED_FORMATS = {".blf": "BLF", ".mf4": "MF4", ".mdf4": "MF4", ".trc": "TRC"}
DBC_EXTENSIONS = {".dbc"}

_ASC_WS = "[ \\t\\n\\x0B\\f\\r]+"


def format_of(path: str) -> str:
    """Format name chosen by the last suffix, case-insensitive."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in TEXT_FORMATS:
        return TEXT_FORMATS[ext]
    raise UnsupportedFormat(path, UNSUPPORTED_FORMATS.get(ext))


def classify_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``paths`` with ``extension``, the ``source_format`` it names (null if none can be read)
    and ``known_format``, the name of a recognised format without a reader (S1, S11).

    The rule of ``format_of`` as columns, for listings too long for the driver."""
    name = F.substring_index(F.regexp_replace(path_col, "/+$", ""), "/", -1)
    ext = F.lower(F.regexp_extract(name, r"[^.].*(\.[^.]*)$", 1))

    def named(table: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(ext == e, F.lit(f)) for e, f in table.items()])

    return paths.withColumns({"extension": ext, "source_format": named(TEXT_FORMATS), "known_format": named(UNSUPPORTED_FORMATS)})


@dataclass
class _Parsed:
    skip: Column  # line is not a record (blank, header, other bus): never an error
    ok: Column  # line parsed into a frame
    ts: Column
    can_id: Column
    dlc: Column
    channel: Column
    frame_type: Column
    payload: Column


def _last_digit(iface: Column) -> Column:
    """The channel an interface names, as the reference reads it: its last digit, past three characters."""
    last = F.substring(iface, -1, 1)
    return F.when((F.length(iface) > 3) & last.between("0", "9"), last.cast("int")).otherwise(F.lit(0))


def _whole_number(iface: Column) -> Column:
    """The number an interface ends in (``can12`` is 12), kept to eight bits as other channels are."""
    return F.coalesce(dec_mod_256(F.nullif(F.regexp_extract(iface, "([0-9]+)$", 1), F.lit(""))), F.lit(0))


def _parse_candump(t: Column, exact: bool = False, channel_of: Callable[[Column], Column] = _last_digit) -> _Parsed:
    # Three words: "(seconds)", interface, "id#data"; each is checked by itself.
    words = F.split(t, _ASC_WS)
    stamp, iface = F.get(words, 0), F.coalesce(F.get(words, 1), F.lit(""))
    sides = F.split(F.get(words, 2), "#")
    seconds = F.substring_index(F.substring_index(stamp, "(", -1), ")", 1)
    channel = channel_of(iface)
    ts = seconds_to_ns(seconds, exact)
    digits = F.coalesce(F.get(sides, 0), F.lit(""))
    can_id = hex_to_long(digits)
    data = F.coalesce(F.get(sides, 1), F.lit(""))
    payload, dlc = parse_payload(data)
    shaped = (F.size(words) == 3) & (F.size(sides) == 2) & (stamp == F.concat(F.lit("("), seconds, F.lit(")")))
    spelled = seconds.rlike(r"^\d+(\.\d+)?$") & ~iface.rlike("[^A-Za-z0-9_]") & ~F.concat(digits, data).rlike("[^0-9A-Fa-f]")
    ok = shaped & spelled & (digits != "") & ts.isNotNull() & valid_can_id(can_id) & payload.isNotNull()
    return _Parsed(F.lit(False), ok, ts, can_id, dlc, channel, F.lit(0), payload)


def _parse_csv(t: Column, exact: bool = False) -> _Parsed:
    tok = F.split(t, ",")
    tk = lambda i: ws_trim(F.get(tok, i))
    skip = F.lower(tk(0)) == "timestamp"
    n = F.size(tok)
    ts = seconds_to_ns(tk(0), exact)
    channel = dec_mod_256(tk(1))
    can_id = hex_to_long(tk(2))
    payload, dlc = parse_payload(tk(4))
    fd = F.when((n > 5) & (F.lower(F.coalesce(tk(5), F.lit(""))) == "fd"), F.lit(1)).otherwise(F.lit(0))
    ok = (n >= 5) & ts.isNotNull() & channel.isNotNull() & valid_can_id(can_id) & payload.isNotNull()
    return _Parsed(skip, ok, ts, can_id, dlc, channel, fd, payload)


def _asc_steps(lines: DataFrame) -> DataFrame:
    """ASC lines with what several fields need, each computed once per line: tokens, kind, fields, values, data.

    Nested into each other they would be split and matched anew at each of some hundred places, in one method too
    long for the JIT compiler."""
    tok = lambda i: F.get(F.col("_tok"), i)
    of_kind = lambda fd, classic: F.when(F.col("_fd"), tok(fd)).otherwise(tok(classic))
    lines = _once(lines, _tok=F.split("_g", _ASC_WS))
    lines = _once(lines, _fd=F.lower(F.coalesce(tok(1), F.lit(""))) == "canfd")
    lines = _once(lines, _time=tok(0), _bus=of_kind(2, 1), _id=F.regexp_replace(of_kind(4, 2), "[xX]$", ""), _size=of_kind(8, 5))
    lines = _once(lines, _id=hex_to_long("_id"), _bus=dec_mod_256("_bus"), _numbered=dec_to_long("_bus").isNotNull(), _size=dec_to_long("_size"))
    dlc_ok = F.col("_size").isNotNull() & (F.col("_size") <= 64)
    lines = _once(lines, _dlc_ok=dlc_ok, _dlc=F.when(dlc_ok, F.col("_size")).otherwise(F.lit(0)).cast("int"))
    first = F.when(F.col("_fd"), F.lit(10)).otherwise(F.lit(7))  # 1-based index of the first data byte
    lines = _once(lines, _data=F.array_join(F.slice("_tok", first, F.greatest("_dlc", F.lit(0))), " "))
    return _once(lines, _data=F.when(F.col("_data") == "", F.lit("")).otherwise(hex_tokens_to_hex("_data")))


def _once(lines: DataFrame, **fields: Column) -> DataFrame:
    """``lines`` with further columns that are computed here and nowhere else: a one-row generator keeps later
    projections from repeating their expressions."""
    return lines.select(*[c for c in lines.columns if c not in fields], F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))))


def _parse_asc(t: Column, exact: bool = False) -> _Parsed:
    """The fields of a line of ``_asc_steps``; ``t`` is the line itself."""
    n, is_fd, dlc = F.size("_tok"), F.col("_fd"), F.col("_dlc")
    skip = (~F.substring(t, 1, 1).rlike("^[0-9]$")) | (n < 2) | (~is_fd & ~F.col("_numbered"))
    payload = F.unhex(F.rpad("_data", dlc * 2, "0"))
    ts = seconds_to_ns(F.col("_time"), exact)
    enough = F.when(is_fd, n >= 10).otherwise(n >= 7)
    ok = enough & F.col("_bus").isNotNull() & ts.isNotNull() & valid_can_id("_id") & F.col("_dlc_ok") & F.col("_data").isNotNull()
    return _Parsed(skip, ok, ts, F.col("_id"), dlc, F.col("_bus"), F.when(is_fd, F.lit(1)).otherwise(F.lit(0)), payload)


_PARSERS = {"candump": _parse_candump, "csv": _parse_csv, "asc": _parse_asc}


# Lines that are frames as they stand: digits of a time in range, an id of 29 bits, whole bytes.
_ID, _BYTE = "[01]?[0-9A-Fa-f]{1,7}", "[0-9A-Fa-f]{2}"
PLAIN = {
    "csv": rf"^[0-9]{{1,9}}\.[0-9]{{1,9}},[0-9]{{1,3}},{_ID},[0-9]{{0,3}},(?:{_BYTE}(?: {_BYTE}){{0,63}})?,(?:CAN|FD)$",
    "candump": rf"^\([0-9]{{1,9}}\.[0-9]{{1,9}}\) [A-Za-z]{{1,12}}[0-9]{{0,3}} {_ID}#(?:{_BYTE}){{0,64}}$",
}


def _plain_csv(t: Column, exact: bool) -> _Parsed:
    tok = F.split(t, ",")
    data = F.replace(F.get(tok, 4), F.lit(" "), F.lit(""))
    return _Parsed(F.lit(False), F.lit(True), _plain_ns(F.get(tok, 0), exact), _plain_hex(F.get(tok, 2)), F.length(data) / 2, F.pmod(F.get(tok, 1).cast("int"), F.lit(256)),
                   F.when(F.get(tok, 5) == "FD", F.lit(1)).otherwise(F.lit(0)), F.unhex(data))


def _plain_candump(t: Column, exact: bool, channel_of: Callable[[Column], Column] = _last_digit) -> _Parsed:
    words = F.split(t, " ")
    sides = F.split(F.get(words, 2), "#")
    data, channel = F.get(sides, 1), channel_of(F.get(words, 1))
    return _Parsed(F.lit(False), F.lit(True), _plain_ns(F.translate(F.get(words, 0), "()", ""), exact), _plain_hex(F.get(sides, 0)), F.length(data) / 2, channel, F.lit(0), F.unhex(data))


def _plain_ns(seconds: Column, exact: bool) -> Column:
    return seconds_to_ns(seconds, True) if exact else (seconds.cast("double") * F.lit(1e9)).cast("bigint")


def _plain_hex(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


_PLAIN_PARSERS = {"csv": _plain_csv, "candump": _plain_candump}


def _told_apart(lines: DataFrame, fmt: str) -> DataFrame:
    """``lines`` with the trimmed text as ``_p`` if it is plainly spelled, else as ``_g``; the other is null.

    They come out of a one-row generator, so the pattern is tried once per line."""
    line = ws_trim(F.col("value"))
    plain = line.rlike(PLAIN[fmt]) if fmt in PLAIN else F.lit(False)
    lines = lines.select("*", F.inline_outer(F.array(F.struct(F.when(plain, line).alias("_p"), F.when(~plain, line).alias("_g")))))
    return _asc_steps(lines) if fmt == "asc" else lines


def _flags(p: _Parsed) -> tuple[Column, Column]:
    """Whether a line is a record, and a frame, by the full checks."""
    record = (F.col("_g") != "") & ~F.coalesce(p.skip, F.lit(False))
    return record, record & F.coalesce(p.ok, F.lit(False))


def _either(plain: Column | None, general: Column, dtype: str) -> Column:
    """The value of whichever way took the line; both are computed, so that their common parts are once."""
    general = general.cast(dtype)
    return general if plain is None else F.greatest(plain.cast(dtype), general)


def parse_lines(lines: DataFrame, fmt: str, exact_time: bool = False, full_channel: bool = False) -> DataFrame:
    """Add ``is_record`` (not blank/skipped), ``is_frame`` and the frame fields."""
    options = [exact_time] + ([_whole_number] if full_channel and fmt == "candump" else [])
    g = _PARSERS[fmt](F.col("_g"), *options)
    p = _PLAIN_PARSERS[fmt](F.col("_p"), *options) if fmt in PLAIN else None
    known, record, frame = F.col("_p").isNotNull(), *_flags(g)

    def guarded(c: str) -> tuple[Column | None, Column]:
        """Fields with a default value are null on lines that took the other way."""
        return None if p is None else F.when(known, getattr(p, c)), F.when(~known, getattr(g, c))

    return _told_apart(lines, fmt).select(
        *lines.columns,
        (known | F.coalesce(record, F.lit(False))).alias("is_record"),
        (known | F.coalesce(frame, F.lit(False))).alias("is_frame"),
        _either(None if p is None else p.ts, g.ts, "bigint").alias("timestamp_ns"),
        _either(None if p is None else p.can_id, g.can_id, "bigint").alias("can_id"),
        _either(None if p is None else p.dlc, g.dlc, "int").alias("dlc"),
        _either(*guarded("channel"), "int").alias("channel"),
        _either(*guarded("frame_type"), "int").alias("frame_type"),
        _either(None if p is None else p.payload, g.payload, "binary").alias("payload"),
    )


def flag_lines(lines: DataFrame, fmt: str) -> DataFrame:
    """``lines`` with ``is_record`` and ``is_frame`` only, for counting."""
    record, frame = _flags(_PARSERS[fmt](F.col("_g")))
    known = F.col("_p").isNotNull()
    return _told_apart(lines, fmt).select(*lines.columns, (known | F.coalesce(record, F.lit(False))).alias("is_record"), (known | F.coalesce(frame, F.lit(False))).alias("is_frame"))


def _expand(spark: SparkSession, paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _group_by_format(paths: list[str], fmt: str | None) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for p in paths:
        groups.setdefault(fmt or format_of(p), []).append(p)
    return groups


def _line_text(value: Column) -> Column:
    return F.regexp_replace(value, "\r$", "")


def _is_bad() -> Column:
    return F.col("is_record") & ~F.col("is_frame")


def _count_splits(lines: DataFrame, fmt: str) -> DataFrame:
    return split_table(flag_lines(lines, fmt), F.col("is_frame"), _is_bad())


def bad_lines(spark: SparkSession, paths, fmt: str | None = None) -> DataFrame:
    """(trace_id, line_no, text) of every record line that does not parse."""
    out = None
    for f, ps in _group_by_format(_expand(spark, paths), fmt).items():
        lines = scan_lines(spark, ps)
        bad = flag_lines(lines, f).filter(_is_bad())
        splits = _count_splits(lines, f)
        bad = join_small(bad, splits.select(*SPLIT_KEYS, "line_base", "min_mid"), SPLIT_KEYS, max_rows=MAX_SPLIT_ROWS_COMPACT)
        bad = bad.select(F.col("file_path").alias("trace_id"), (F.col("line_base") + F.col("mid") - F.col("min_mid") + 1).alias("line_no"), _line_text(F.col("value")).alias("text"))
        out = bad if out is None else out.unionByName(bad)
    return out


def scan_stats(spark: SparkSession, paths, fmt: str | None = None) -> DataFrame:
    """One row per trace of a whole scan: lines, frames, rejected lines and bytes consumed.

    A line takes its bytes and its line end; the last line of a file may have none."""
    out = None
    for f, ps in _group_by_format(_expand(spark, paths), fmt).items():
        found = _count_splits(scan_lines(spark, ps), f).groupBy(F.col("file_path").alias("trace_id")).agg(
            F.sum("n_lines").alias("lines"), F.sum("n_frames").alias("frames"), F.sum("n_bad").alias("rejected"),
            F.least(F.sum("n_bytes"), F.max("file_size")).alias("bytes_consumed"), F.lit(f).alias("source_format"))
        out = found if out is None else out.unionByName(found)
    return out


def read_trace(spark: SparkSession, paths, fmt: str | None = None, mode: str = "strict",
               keep_source: bool = False, exact_time: bool = False, full_channel: bool = False) -> DataFrame:
    """Read text traces into the ``frames`` table.

    ``paths``: a path, glob or list; each file is one trace (``trace_id`` = file path) with
    its own dense 0-based ``ordinal``.  ``fmt`` overrides the extension rule.  ``mode`` is
    ``"strict"`` (first bad line raises ``TraceParseError``) or ``"tolerant"`` (bad lines
    are dropped; see ``bad_lines``).  ``exact_time=True`` keeps every nanosecond digit of
    the seconds text instead of the reference's double arithmetic; ``full_channel=True`` takes the whole
    number at the end of a candump interface as the channel instead of its last digit."""
    if mode not in ("strict", "tolerant"):
        raise ValueError(f"mode must be 'strict' or 'tolerant', not {mode!r}")
    out = None
    for f, ps in _group_by_format(_expand(spark, paths), fmt).items():
        lines = scan_lines(spark, ps)
        splits = _count_splits(lines, f)
        if mode == "strict":
            _raise_first_bad(lines, splits)
        rows = parse_lines(lines, f, exact_time, full_channel).filter("is_frame").select(
            "file_path", "block_start", "file_size", "timestamp_ns", "can_id", "dlc", "channel", "frame_type", "payload")
        frames = numbered(rows, splits).withColumn("trace_id", F.col("file_path")).withColumn("source_format", F.lit(f))
        cols = FRAME_COLUMNS + (["source_format", "file_size"] if keep_source else [])
        frames = frames.select(*cols)
        out = frames if out is None else out.unionByName(frames)
    return out


def _raise_first_bad(lines: DataFrame, splits: DataFrame) -> None:
    number = F.col("line_base") + F.col("bad_mid") - F.col("min_mid") + 1
    first = splits.filter("n_bad > 0").select("file_path", number.alias("line_no"), "bad_mid").orderBy("file_path", "line_no").first()
    if first is not None:
        text = lines.filter((F.col("file_path") == first["file_path"]) & (F.col("mid") == first["bad_mid"])).select(_line_text(F.col("value"))).first()[0]
        raise TraceParseError(first["file_path"], int(first["line_no"]), text)


def trace_metadata(frames: DataFrame, files: DataFrame | None = None, fmt: str | None = None) -> DataFrame:
    """One row per trace: count, first/last timestamp in file order, size, format.

    ``frames`` must carry ``source_format`` and ``file_size`` (``keep_source=True``).  With
    ``files`` (of ``discover_traces``) each listed trace has a row: one without frames has
    count 0, null timestamps, its size, and ``fmt`` or the format its extension names."""
    found = _metadata(frames)
    if files is None:
        return found
    listed = classify_paths(files).select("trace_id", "size_bytes", F.coalesce(F.lit(fmt), "source_format").alias("named"))
    return listed.join(found, "trace_id", "left").select(
        "trace_id", F.coalesce("event_count", F.lit(0)).cast("bigint").alias("event_count"), "start_timestamp_ns", "end_timestamp_ns",
        F.col("size_bytes").alias("source_size_bytes"), F.coalesce("source_format", "named").alias("source_format"))


def _metadata(frames: DataFrame) -> DataFrame:
    return frames.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("timestamp_ns", "ordinal").alias("start_timestamp_ns"),
        F.max_by("timestamp_ns", "ordinal").alias("end_timestamp_ns"),
        F.first("file_size").alias("source_size_bytes"),
        F.first("source_format").alias("source_format"),
    )


def discover_traces(spark: SparkSession, folder: str, include_dbc: bool = True) -> DataFrame:
    """Readable trace (and DBC) files in a folder, sorted by path (S12); ``trace_id`` as ``read_trace`` names them.

    A file scan gives no row for a file of no bytes; those come from the listing that the scan's relation made."""
    exts = set(TEXT_FORMATS) | (DBC_EXTENSIONS if include_dbc else set())
    pattern = "|".join(e.lstrip(".") for e in sorted(exts))
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = scan.select(F.col("path"), F.col("length").alias("size_bytes"), F.col("_metadata.file_path").alias("trace_id"))
    # the listing spells a local path with an empty authority (file:///), rows without (file:/)
    listed = spark.createDataFrame([(re.sub("^file:///", "file:/", p),) for p in scan.inputFiles()], "trace_id string")
    path = F.url_decode(F.replace(F.col("trace_id"), F.lit("+"), F.lit("%2B")))
    empty = listed.join(files.select("trace_id"), "trace_id", "left_anti").select(path.alias("path"), F.lit(0).cast("bigint").alias("size_bytes"), "trace_id")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.unionByName(empty).filter(ext.rlike(f"^({pattern})$")).withColumn("extension", ext).orderBy("path")
