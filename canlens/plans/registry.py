"""Registered queries: one entry per operator group of SURVEY §2, each with a DuckDB oracle.

Every query reads the driver's tables (``events``) or data Spark derives from them
(rendered text traces, a saved Parquet store, a dictionary generated from the users), so
its work grows with the input.  Spark outputs are projected to BIGINT / DOUBLE / VARCHAR /
BOOLEAN columns whose names equal the oracle's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import context as ctx
from ..operators import hooks
from ..operators import paging
from ..operators import summary as summ
from ..operators.decode import can_decode, decode_long, decode_nested, explode_signals
from ..operators.filters import (
    Not,
    Pred,
    Rule,
    all_of,
    any_of,
    compile_raw,
    from_clauses,
    from_rules,
    negate,
    hide_ids,
    same_signal,
    time_range,
)
from ..operators.session import TraceSession
from ..session import ensure_checkpoint_dir, scratch_path, write_shared_bytes
from ..sources.dbc import Dbc, load_dbc, write_dbc_text
from ..sources.fixtures import EVENTS_DBC, TEXT_EPOCH_NS, events_frames
from .oracle import FRAMES_CTE, LONG_COLS, RAW_COLS, with_frames, with_signals
from .query import early_stop_counts, run_query, summary_counts

# Query parameters (times are UTC instants of 2024 in ns).
T_JAN05 = 1704412800 * 10**9
T_JAN10 = 1704844800 * 10**9
T_JAN20 = 1705708800 * 10**9
PAGE_SIZE = 2000
CHUNK_SIZE = 512

_DBC_CACHE: dict[str, Dbc] = {}


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return events_frames(spark, sf)


def events_dbc(spark: SparkSession) -> Dbc:
    """The fixture dictionary, loaded once per Spark application."""
    key = spark.sparkContext.applicationId
    if key not in _DBC_CACHE:
        ensure_checkpoint_dir(spark)
        _DBC_CACHE[key] = load_dbc(spark, write_dbc_text(spark, EVENTS_DBC, scratch_path(spark, "dbc")))
    return _DBC_CACHE[key]


def _raw_exprs() -> list:
    return [
        F.col("ordinal").cast("bigint"), F.col("timestamp_ns").cast("bigint"), F.col("can_id").cast("bigint"),
        F.col("dlc").cast("bigint"), F.col("channel").cast("bigint"), F.col("frame_type").cast("bigint"),
        F.hex("payload").alias("payload_hex")]


def raw_out(df: DataFrame) -> DataFrame:
    return df.select(*_raw_exprs())


def long_out(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("ordinal").cast("bigint"), F.col("can_id").cast("bigint"), "message_name",
        F.col("signal_index").cast("bigint"), "signal_name", F.col("raw_value").cast("bigint"),
        F.col("value").cast("double"), "unit", "value_description")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------- raw filters

@register("raw_filter_time", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE timestamp_ns >= {T_JAN05} AND timestamp_ns < {T_JAN20}"))
def q_raw_filter_time(spark, sf):
    tree = all_of(Pred("timestamp_ns", "ge", T_JAN05), Pred("timestamp_ns", "lt", T_JAN20))
    return raw_out(run_query(frames(spark, sf), raw_filter=tree))


@register("raw_filter_can_id", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE can_id = 258"))
def q_raw_filter_can_id(spark, sf):
    return raw_out(run_query(frames(spark, sf), raw_filter=Pred("can_id", "eq", 258)))


@register("raw_filter_channel", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE channel <> 1"))
def q_raw_filter_channel(spark, sf):
    return raw_out(run_query(frames(spark, sf), raw_filter=Pred("channel", "ne", 1)))


@register("raw_filter_frame_type", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE frame_type = 1"))
def q_raw_filter_frame_type(spark, sf):
    return raw_out(run_query(frames(spark, sf), raw_filter=Pred("frame_type", "eq", "canfd")))


@register("raw_filter_double_compat", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE can_id::DOUBLE > 256.5 AND channel::DOUBLE <= 1.0 AND "
    f"timestamp_ns::DOUBLE >= {float(T_JAN10)!r}"))
def q_raw_filter_double_compat(spark, sf):
    """every numeric pair compared as DOUBLE, as the reference does."""
    tree = all_of(Pred("can_id", "gt", 256.5), Pred("channel", "le", True), Pred("timestamp_ns", "ge", T_JAN10))
    return raw_out(run_query(frames(spark, sf), raw_filter=tree, double_compat=True))


@register("raw_filter_tree", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE (can_id = 256 OR can_id = 257) AND NOT (channel = 0) "
    f"AND timestamp_ns >= {T_JAN10}"))
def q_raw_filter_tree(spark, sf):
    tree = all_of(any_of(Pred("can_id", "eq", 256), Pred("can_id", "eq", 257)),
                  negate(Pred("channel", "eq", 0)), Pred("timestamp_ns", "ge", T_JAN10))
    return raw_out(run_query(frames(spark, sf), raw_filter=tree))


@register("raw_filter_empty_nodes", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE NOT (can_id = 260)"))
def q_raw_filter_empty_nodes(spark, sf):
    """Empty OR and child-less NOT match everything; NOT takes its first child only."""
    tree = all_of(any_of(), negate(), Not((Pred("can_id", "eq", 260), Pred("can_id", "eq", 256))))
    return raw_out(run_query(frames(spark, sf), raw_filter=tree))


@register("clause_lists", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE channel <= 1 AND (can_id = 256 OR can_id = 259) AND NOT (frame_type = 1)"))
def q_clause_lists(spark, sf):
    tree = from_clauses(and_clauses=[("channel", "le", 1)], or_clauses=[("can_id", "eq", 256), ("can_id", "eq", 259)],
                        not_clauses=[("frame_type", "eq", 1)])
    return raw_out(run_query(frames(spark, sf), raw_filter=tree))


@register("rule_lists", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE frame_type = 0 AND (can_id = 256 OR can_id = 258 OR can_id = 260) "
    f"AND channel = 0 AND NOT (channel = 2)"))
def q_rule_lists(spark, sf):
    """a list value expands ('|' or ',' → any, '&' → must, '!' item → exclude); a
    lone '!2' is not a list and, unparsable as a number, is dropped like the reference."""
    rules = [
        Rule("can_id", "eq", "256 | 258, 260"),
        Rule("channel", "eq", "0 & !2"),
        Rule("channel", "eq", "!1"),
        Rule("frame_type", "eq", "can"),
        Rule("can_id", "eq", "999", enabled=False),
        Rule("channel", "eq", "not-a-number"),
    ]
    return raw_out(run_query(frames(spark, sf), raw_filter=from_rules(rules)))


@register("misplaced_leaf", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE channel = 2"))
def q_misplaced_leaf(spark, sf):
    """a decoded leaf in a raw filter is true (false under NOT)."""
    tree = any_of(all_of(Pred("message_name", "eq", "x"), Pred("channel", "eq", 2)),
                  negate(Pred("signal_value", "gt", 5)))
    return raw_out(run_query(frames(spark, sf), raw_filter=tree))


@register("ordinal_range", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE ordinal BETWEEN 1000 AND 6999 AND can_id <> 260"))
def q_ordinal_range(spark, sf):
    return raw_out(run_query(frames(spark, sf), raw_filter=Pred("can_id", "ne", 260), ordinal_start=1000,
                             ordinal_end=6999))


@register("time_range", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE timestamp_ns >= {T_JAN10} AND timestamp_ns <= {T_JAN20}"))
def q_time_range(spark, sf):
    return raw_out(run_query(frames(spark, sf), raw_filter=time_range(T_JAN10, T_JAN20)))


@register("single_id", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE channel = 1 AND can_id = 257"))
def q_single_id(spark, sf):
    return raw_out(run_query(frames(spark, sf), raw_filter=Pred("channel", "eq", 1), can_id=257))


@register("single_id_compat", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE channel = 1"))
def q_single_id_compat(spark, sf):
    """F13 as the reference: the id shortcut is ignored when a filter is present."""
    return raw_out(run_query(frames(spark, sf), raw_filter=Pred("channel", "eq", 1), can_id=257,
                             compat_single_id=True))


@register("hide_ids", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE can_id NOT IN (256, 260)"))
def q_hide_ids(spark, sf):
    return raw_out(hide_ids(frames(spark, sf), [256, 260]))


@register("hide_ids_table", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE can_id NOT IN (SELECT can_id FROM frames WHERE can_id >= 259 AND channel = 2)"))
def q_hide_ids_table(spark, sf):
    """F16 with a hidden-id table derived from the data (left-anti join)."""
    fr = frames(spark, sf)
    hidden = run_query(fr, raw_filter=all_of(Pred("can_id", "ge", 259), Pred("channel", "eq", 2)))
    return raw_out(hide_ids(fr, hidden))


@register("show_undecoded", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE can_id NOT IN (256, 257, 258, 259)"))
def q_show_undecoded(spark, sf):
    dec = run_query(frames(spark, sf), dbc=events_dbc(spark), decode=True, keep_undecoded=True)
    return raw_out(dec.filter(F.col("message_name").isNull()))


@register("show_decoded", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE can_id IN (256, 257, 258, 259)"))
def q_show_decoded(spark, sf):
    dec = run_query(frames(spark, sf), dbc=events_dbc(spark), decode=True, keep_undecoded=True)
    return raw_out(dec.filter(F.col("message_name").isNotNull()))


# --------------------------------------------------------------------------- decode

def _long(spark, sf) -> DataFrame:
    return decode_long(frames(spark, sf), events_dbc(spark))


@register("decode_long", with_signals(f"SELECT {LONG_COLS} FROM signals"))
def q_decode_long(spark, sf):
    return long_out(_long(spark, sf))


def _signal_query(name: str, signal: str, can_ids: str = "256, 257, 258, 259"):
    sql = with_signals(f"SELECT {LONG_COLS} FROM signals WHERE signal_name = '{signal}' AND can_id IN ({can_ids})")

    @register(name, sql)
    def q(spark, sf):
        ids = [int(x) for x in can_ids.split(",")]
        return long_out(_long(spark, sf).filter((F.col("signal_name") == signal) & F.col("can_id").isin(ids)))
    return q


_signal_query("decode_le", "Seq")
_signal_query("decode_scaled", "EvtValue")
_signal_query("decode_signed", "UserTag")
_signal_query("decode_be", "ValueBE")
_signal_query("decode_truncated", "Trunc", "259")
_signal_query("decode_labels", "Sel")


@register("decode_mux", with_signals(f"SELECT {LONG_COLS} FROM signals WHERE signal_name IN ('Sel', 'Even', 'Odd')"))
def q_decode_mux(spark, sf):
    return long_out(_long(spark, sf).filter(F.col("signal_name").isin("Sel", "Even", "Odd")))


@register("decode_long_join", with_signals(f"SELECT {LONG_COLS} FROM signals"))
def q_decode_long_join(spark, sf):
    """P9 through the broadcast join with the dictionary (the path for large dictionaries)."""
    return long_out(decode_long(frames(spark, sf), events_dbc(spark), strategy="join"))


@register("decode_nested_join", with_signals(f"SELECT {LONG_COLS} FROM signals"))
def q_decode_nested_join(spark, sf):
    """P9 nested via the join path with higher-order functions, flattened."""
    return long_out(explode_signals(decode_nested(frames(spark, sf), events_dbc(spark), strategy="join")))


@register("decode_salted_join", with_signals(f"SELECT {LONG_COLS} FROM signals"))
def q_decode_salted_join(spark, sf):
    """P9 when the dictionary exceeds the broadcast bound: salted shuffle join."""
    return long_out(decode_long(frames(spark, sf), events_dbc(spark), strategy="join", max_broadcast_rows=0,
                                salt_buckets=16))


@register("decode_nested_long", with_signals(f"SELECT {LONG_COLS} FROM signals"))
def q_decode_nested_long(spark, sf):
    """P9 + P10: nested decode, then flattened in dictionary order."""
    return long_out(explode_signals(decode_nested(frames(spark, sf), events_dbc(spark))))


@register("decode_inner", with_frames(
    "SELECT can_id, COUNT(*) AS n_frames FROM frames WHERE can_id IN (256, 257, 258, 259) GROUP BY can_id"))
def q_decode_inner(spark, sf):
    """P1 + P11: only frames with a definition survive a decode."""
    dec = can_decode(frames(spark, sf), events_dbc(spark))
    return dec.groupBy("can_id").agg(F.count(F.lit(1)).alias("n_frames"))


@register("decode_nested_count", with_frames(
    "SELECT ordinal, CASE can_id WHEN 256 THEN 'Click' WHEN 257 THEN 'View' WHEN 258 THEN 'Purchase' "
    "ELSE 'Signup' END AS message_name, CAST(CASE WHEN can_id = 259 THEN 2 ELSE 6 END AS BIGINT) AS n_signals "
    "FROM frames WHERE can_id IN (256, 257, 258, 259)"))
def q_decode_nested_count(spark, sf):
    dec = decode_nested(frames(spark, sf), events_dbc(spark))
    return dec.select(F.col("ordinal").cast("bigint"), "message_name",
                      F.size("signals").cast("bigint").alias("n_signals"))


# --------------------------------------------------------------------------- decoded filters

def _decoded_frames_sql(where: str) -> str:
    return with_signals(
        "SELECT f.ordinal, f.can_id, f.timestamp_ns FROM frames f WHERE f.can_id IN (256, 257, 258, 259) AND "
        + where)


def _decoded_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("ordinal").cast("bigint"), F.col("can_id").cast("bigint"),
                     F.col("timestamp_ns").cast("bigint"))


@register("decoded_message_name", _decoded_frames_sql("lower(CASE f.can_id WHEN 256 THEN 'Click' WHEN 257 THEN 'View'"
                                                      " WHEN 258 THEN 'Purchase' ELSE 'Signup' END) LIKE '%li%'"))
def q_decoded_message_name(spark, sf):
    return _decoded_out(run_query(frames(spark, sf), dbc=events_dbc(spark),
                                  decoded_filter=Pred("message_name", "contains", "LI")))


@register("decoded_signal_name", _decoded_frames_sql(
    "EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND lower(s.signal_name) = 'odd')"))
def q_decoded_signal_name(spark, sf):
    return _decoded_out(run_query(frames(spark, sf), dbc=events_dbc(spark),
                                  decoded_filter=Pred("signal_name", "eq", "ODD")))


@register("decoded_signal_name_ne", _decoded_frames_sql(
    "EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND lower(s.signal_name) <> 'evtvalue')"))
def q_decoded_signal_name_ne(spark, sf):
    """Q16: ``ne`` on signal names means "some other signal exists"."""
    return _decoded_out(run_query(frames(spark, sf), dbc=events_dbc(spark),
                                  decoded_filter=Pred("signal_name", "ne", "EvtValue")))


@register("decoded_signal_value", _decoded_frames_sql(
    "EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND s.value > 300.0::DOUBLE)"))
def q_decoded_signal_value(spark, sf):
    return _decoded_out(run_query(frames(spark, sf), dbc=events_dbc(spark),
                                  decoded_filter=Pred("signal_value", "gt", 300.0)))


@register("decoded_tree", _decoded_frames_sql(
    "f.can_id = 257 AND NOT EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND s.value = 0.0::DOUBLE) "
    "AND (EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND lower(s.signal_name) = 'even') "
    "OR EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND s.value < 1.0::DOUBLE))"))
def q_decoded_tree(spark, sf):
    tree = all_of(Pred("message_name", "eq", "view"), negate(Pred("signal_value", "eq", 0)),
                  any_of(Pred("signal_name", "eq", "Even"), Pred("signal_value", "lt", 1.0)))
    return _decoded_out(run_query(frames(spark, sf), dbc=events_dbc(spark), decoded_filter=tree))


@register("decoded_tree_join", _decoded_frames_sql(
    "f.can_id = 257 AND NOT EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND s.value = 0.0::DOUBLE) "
    "AND (EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND lower(s.signal_name) = 'even') "
    "OR EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND s.value < 1.0::DOUBLE))"))
def q_decoded_tree_join(spark, sf):
    """G4 on the join path (dictionaries too large to compile): ``exists`` over the array."""
    tree = all_of(Pred("message_name", "eq", "view"), negate(Pred("signal_value", "eq", 0)),
                  any_of(Pred("signal_name", "eq", "Even"), Pred("signal_value", "lt", 1.0)))
    return _decoded_out(run_query(frames(spark, sf), dbc=events_dbc(spark), decoded_filter=tree, strategy="join"))


@register("raw_then_decoded", _decoded_frames_sql(
    "f.channel = 2 AND f.frame_type = 0 AND EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal "
    "AND s.value >= 100.0::DOUBLE) AND NOT EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal "
    "AND lower(s.signal_name) = 'trunc')"))
def q_raw_then_decoded(spark, sf):
    """Ordinal range → raw filter → decode → decoded filter."""
    return _decoded_out(run_query(
        frames(spark, sf), dbc=events_dbc(spark),
        raw_filter=all_of(Pred("channel", "eq", 2), Pred("frame_type", "eq", "can")),
        decoded_filter=all_of(Pred("signal_value", "ge", 100), negate(Pred("signal_name", "eq", "trunc")))))


@register("same_signal", _decoded_frames_sql(
    "EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND lower(s.signal_name) = 'evtvalue' "
    "AND s.value > 300.0::DOUBLE)"))
def q_same_signal(spark, sf):
    return _decoded_out(run_query(frames(spark, sf), dbc=events_dbc(spark),
                                  same_signal_filter=("EvtValue", "gt", 300.0)))


@register("same_signal_join", _decoded_frames_sql(
    "EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND lower(s.signal_name) = 'evtvalue' "
    "AND s.value > 300.0::DOUBLE)"))
def q_same_signal_join(spark, sf):
    """G5 on the join path: ``exists`` over the nested signal array."""
    dec = decode_nested(frames(spark, sf), events_dbc(spark), strategy="join")
    return _decoded_out(dec.filter(same_signal("EvtValue", "gt", 300.0)))


# --------------------------------------------------------------------------- order, limits, paging

@register("first_match", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE can_id = 259 AND channel = 2 ORDER BY ordinal LIMIT 1"))
def q_first_match(spark, sf):
    tree = all_of(Pred("can_id", "eq", 259), Pred("channel", "eq", 2))
    return raw_out(run_query(frames(spark, sf), raw_filter=tree, first_only=True))


@register("max_matches", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE can_id = 258 AND frame_type = 1 ORDER BY ordinal LIMIT 25"))
def q_max_matches(spark, sf):
    tree = all_of(Pred("can_id", "eq", 258), Pred("frame_type", "eq", 1))
    return raw_out(run_query(frames(spark, sf), raw_filter=tree, max_matches=25))


@register("page", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE ordinal BETWEEN 4000 AND 5999"))
def q_page(spark, sf):
    # Start at page 1, move forward one page: window [4000, 5999].
    return raw_out(paging.page(frames(spark, sf), start=PAGE_SIZE, size=PAGE_SIZE, pages=1))


_SPAN_SQL = "(SELECT min(timestamp_ns) AS lo, max(timestamp_ns) AS hi FROM frames) b"


@register("zoom_window", with_frames(
    f"SELECT {RAW_COLS} FROM frames, {_SPAN_SQL} WHERE timestamp_ns BETWEEN b.lo + (b.hi - b.lo) // 2 - (b.hi - b.lo) // 8 "
    "AND b.lo + (b.hi - b.lo) // 2 + (b.hi - b.lo) // 8"))
def q_zoom_window(spark, sf):
    """Zoom to a quarter of the full time span around its centre."""
    fr = frames(spark, sf)
    lo, hi = paging.time_bounds(fr)
    return raw_out(paging.time_window(fr, *paging.zoom(lo, hi, 0.25, bounds=(lo, hi))))


@register("zoom_out_clipped", with_frames(f"SELECT {RAW_COLS} FROM frames"))
def q_zoom_out_clipped(spark, sf):
    """Doubling the full span is clipped to the data, so every frame stays."""
    fr = frames(spark, sf)
    lo, hi = paging.time_bounds(fr)
    return raw_out(paging.time_window(fr, *paging.zoom(lo, hi, 2, bounds=(lo, hi))))


@register("centre_window", with_frames(
    f"SELECT {RAW_COLS} FROM frames, {_SPAN_SQL} WHERE timestamp_ns >= b.hi - (b.hi - b.lo) // 4 // 2"))
def q_centre_window(spark, sf):
    """A window of a quarter span centred on the last frame is clipped at the end, not shifted."""
    fr = frames(spark, sf)
    lo, hi = paging.time_bounds(fr)
    return raw_out(paging.time_window(fr, *paging.centre_on(lo, lo + (hi - lo) // 4, hi, bounds=(lo, hi))))


@register("raw_filter_u64", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE can_id = 257"))
def q_raw_filter_u64(spark, sf):
    """literals up to the largest u64, beyond every stored timestamp."""
    tree = all_of(Pred("timestamp_ns", "le", 2**64 - 1), negate(Pred("timestamp_ns", "ge", 2**63)), Pred("can_id", "eq", 257))
    return raw_out(run_query(frames(spark, sf), raw_filter=tree))


# --------------------------------------------------------------------------- context

@register("context_one", with_frames(
    f"SELECT {RAW_COLS}, ordinal - 5000 AS rel_pos FROM frames WHERE ordinal BETWEEN 4997 AND 5004 "
    "AND EXISTS (SELECT 1 FROM frames WHERE ordinal = 5000)"))
def q_context_one(spark, sf):
    c = ctx.context_of(frames(spark, sf), 5000, before=3, after=4)
    return raw_out(c).withColumn("rel_pos", F.col("ordinal") - F.lit(5000))


@register("context_all_matches", with_frames(
    "SELECT m.ordinal AS match_ordinal, f.ordinal, f.ordinal - m.ordinal AS rel_pos, f.can_id, f.timestamp_ns "
    "FROM (SELECT ordinal FROM frames WHERE can_id = 258 AND channel = 2 AND frame_type = 1) m "
    "JOIN frames f ON f.ordinal BETWEEN greatest(m.ordinal - 2, 0) AND m.ordinal + 3"))
def q_context_all_matches(spark, sf):
    fr = frames(spark, sf)
    matches = run_query(fr, raw_filter=all_of(Pred("can_id", "eq", 258), Pred("channel", "eq", 2),
                                              Pred("frame_type", "eq", 1)))
    out = ctx.context_of_matches(fr, matches, before=2, after=3)
    return out.select(F.col("match_ordinal").cast("bigint"), F.col("ordinal").cast("bigint"),
                      F.col("rel_pos").cast("bigint"), F.col("can_id").cast("bigint"),
                      F.col("timestamp_ns").cast("bigint"))


# --------------------------------------------------------------------------- summaries (A1-A5)

@register("summary_counts", with_frames(
    "SELECT trace_id, COUNT(*) AS scanned, COUNT(*) FILTER (WHERE can_id = 257 AND channel = 0) AS matched "
    "FROM frames WHERE ordinal BETWEEN 100 AND 8099 GROUP BY trace_id"))
def q_summary_counts(spark, sf):
    m = compile_raw(all_of(Pred("can_id", "eq", 257), Pred("channel", "eq", 0)))
    return summary_counts(frames(spark, sf), m, ordinal_start=100, ordinal_end=8099)


def _early_stop_sql(where: str, n: int) -> str:
    return with_frames(
        f", hits AS (SELECT ordinal FROM frames WHERE {where} ORDER BY ordinal LIMIT {n}), "
        f"stop AS (SELECT COUNT(*) AS matched, CASE WHEN COUNT(*) = {n} THEN max(ordinal) END AS last FROM hits) "
        "SELECT trace_id, COUNT(*) FILTER (WHERE stop.last IS NULL OR ordinal <= stop.last) AS scanned, "
        "any_value(stop.matched) AS matched FROM frames, stop GROUP BY trace_id")


def _early_stop_query(name: str, tree, where: str, n: int):
    @register(name, _early_stop_sql(where, n))
    def q(spark, sf):
        """A1 with L3: scanned counts frames up to the stopping one, or all if the limit is not reached."""
        return early_stop_counts(frames(spark, sf), compile_raw(tree), n)
    return q


_SIGNUP_CH1 = all_of(Pred("can_id", "eq", 259), Pred("channel", "eq", 1))
_early_stop_query("summary_counts_early_stop", _SIGNUP_CH1, "can_id = 259 AND channel = 1", 40)
_early_stop_query("early_stop_not_reached", _SIGNUP_CH1, "can_id = 259 AND channel = 1", 1_000_000)
_early_stop_query("early_stop_no_match", Pred("can_id", "eq", 99), "can_id = 99", 5)


@register("result_bounds", with_frames(
    "SELECT trace_id, COUNT(*) AS row_count, min(timestamp_ns) AS start_timestamp_ns, "
    "max(timestamp_ns) AS end_timestamp_ns FROM frames WHERE can_id = 256 GROUP BY trace_id"))
def q_result_bounds(spark, sf):
    return summ.result_bounds(run_query(frames(spark, sf), raw_filter=Pred("can_id", "eq", 256)))


@register("distinct_channels", with_frames("SELECT DISTINCT channel FROM frames WHERE can_id = 259"))
def q_distinct_channels(spark, sf):
    r = summ.distinct_channels(run_query(frames(spark, sf), raw_filter=Pred("can_id", "eq", 259)))
    return r.select(F.col("channel").cast("bigint"))


@register("distinct_ids", with_frames("SELECT DISTINCT can_id FROM frames WHERE channel = 1"))
def q_distinct_ids(spark, sf):
    return summ.distinct_ids(run_query(frames(spark, sf), raw_filter=Pred("channel", "eq", 1)))


@register("any_decoded", with_frames(
    "SELECT COALESCE(bool_or(can_id IN (256, 257, 258, 259)), false) AS any_decoded FROM frames WHERE channel = 0"))
def q_any_decoded(spark, sf):
    dec = run_query(frames(spark, sf), raw_filter=Pred("channel", "eq", 0), dbc=events_dbc(spark), decode=True,
                    keep_undecoded=True)
    return summ.any_decoded(dec)


# --------------------------------------------------------------------------- flagship

@register("flagship", with_signals(
    f"SELECT {LONG_COLS} FROM signals WHERE can_id IN (256, 257, 258) AND channel <> 0 AND ordinal IN "
    "(SELECT ordinal FROM signals WHERE lower(signal_name) = 'evtvalue' AND value > 250.0::DOUBLE)"))
def q_flagship(spark, sf):
    """Raw filter → decode → filter on one decoded signal → one row per signal."""
    dec = run_query(frames(spark, sf), dbc=events_dbc(spark),
                    raw_filter=all_of(Pred("can_id", "le", 258), Pred("channel", "ne", 0)),
                    same_signal_filter=("EvtValue", "gt", 250.0))
    return long_out(explode_signals(dec))


# --------------------------------------------------------------------------- text ingest

from ..sources.fixtures import write_text_trace  # noqa: E402
from ..errors import TraceParseError  # noqa: E402
from ..sources.traces import bad_lines, read_trace, scan_stats, trace_metadata  # noqa: E402

#: Rows of a rendered trace file, and the least number of files, as SQL and below as Spark counts them.
TRACE_ROWS, LEAST_FILES = 1_000_000, 4
TRACE_FILES = f"(SELECT greatest({LEAST_FILES}, count(*) // {TRACE_ROWS}) FROM events)"


def trace_files(spark, sf) -> int:
    return max(LEAST_FILES, spark.read.parquet(f"{sf}/events.parquet").count() // TRACE_ROWS)


_TS_SQL = (f"CAST(trunc(CAST(printf('%d.%09d', (timestamp_ns - {TEXT_EPOCH_NS}) // 1000000000, "
           f"(timestamp_ns - {TEXT_EPOCH_NS}) % 1000000000) AS DOUBLE) * 1000000000.0::DOUBLE) AS BIGINT)")
INGEST_COLS = "bucket, ordinal, timestamp_ns, can_id, dlc, channel, frame_type, payload_hex"


def _ingest_sql(frame_type: str = "frame_type", where: str = "TRUE") -> str:
    return with_frames(
        f"SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, CAST(ordinal // {TRACE_FILES} AS BIGINT) AS ordinal, "
        f"{_TS_SQL} AS timestamp_ns, can_id, dlc, channel, CAST({frame_type} AS BIGINT) AS frame_type, payload_hex "
        f"FROM frames WHERE {where}")


def _bucket(trace_id_col="trace_id"):
    return F.regexp_extract(F.col(trace_id_col), r"bucket=(\d+)", 1).cast("bigint").alias("bucket")


def ingest_out(df: DataFrame) -> DataFrame:
    """Parsed frames with the file bucket (from the path) instead of the path."""
    return df.select(_bucket(), *_raw_exprs())


def _written(spark, sf, fmt, **kw) -> str:
    return write_text_trace(frames(spark, sf), scratch_path(spark, f"trace-{fmt}"), fmt, files=trace_files(spark, sf), **kw)


@register("ingest_candump", _ingest_sql(frame_type="0"))
def q_ingest_candump(spark, sf):
    """Candump lines (blank lines mixed in) parsed back into frames."""
    return ingest_out(read_trace(spark, _written(spark, sf, "candump", noise_every=7), fmt="candump"))


@register("ingest_csv", _ingest_sql())
def q_ingest_csv(spark, sf):
    """S3: CSV with a header and repeated header lines inside."""
    return ingest_out(read_trace(spark, _written(spark, sf, "csv", noise_every=50), fmt="csv"))


@register("ingest_asc", _ingest_sql())
def q_ingest_asc(spark, sf):
    """ASC with header lines, other-bus lines, classic and FD frames."""
    return ingest_out(read_trace(spark, _written(spark, sf, "asc", noise_every=11), fmt="asc"))


@register("ingest_tolerant", with_frames(
    f", kept AS (SELECT * FROM frames WHERE ordinal % 97 <> 96) "
    f"SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, "
    f"CAST(row_number() OVER (PARTITION BY ordinal % {TRACE_FILES} ORDER BY ordinal) - 1 AS BIGINT) AS ordinal, "
    f"{_TS_SQL} AS timestamp_ns, can_id, dlc, channel, frame_type, payload_hex FROM kept"))
def q_ingest_tolerant(spark, sf):
    """S6 tolerant: broken lines are dropped and ordinals stay dense over parsed frames."""
    return ingest_out(read_trace(spark, _written(spark, sf, "csv", broken_every=97), fmt="csv", mode="tolerant"))


@register("ingest_bad_lines", with_frames(
    f"SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, CAST(ordinal // {TRACE_FILES} + 2 AS BIGINT) AS line_no, "
    "'bad,line' AS text FROM frames WHERE ordinal % 97 = 96"))
def q_ingest_bad_lines(spark, sf):
    """Every unparsable line with its 1-based physical line number (after the header)."""
    bl = bad_lines(spark, _written(spark, sf, "csv", broken_every=97), fmt="csv")
    return bl.select(_bucket(), F.col("line_no").cast("bigint"), "text")


@register("trace_metadata", with_frames(
    f"SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, COUNT(*) AS event_count, "
    f"arg_min({_TS_SQL}, ordinal) AS start_timestamp_ns, arg_max({_TS_SQL}, ordinal) AS end_timestamp_ns, "
    f"'asc' AS source_format FROM frames GROUP BY 1"))
def q_trace_metadata(spark, sf):
    """Per-trace count, first/last timestamp in file order, format."""
    fr = read_trace(spark, _written(spark, sf, "asc", noise_every=13), fmt="asc", keep_source=True)
    md = trace_metadata(fr)
    return md.select(_bucket(), "event_count", "start_timestamp_ns", "end_timestamp_ns", "source_format")


# --------------------------------------------------------------------------- saved store and lookups

from ..sources import store as st  # noqa: E402
from ..sources.fixtures import write_users_dbc  # noqa: E402
from ..sinks import export as ex  # noqa: E402
from ..streaming.ingest import run_trace_stream_once  # noqa: E402


def _store(spark, sf) -> DataFrame:
    path = st.save_trace(frames(spark, sf), scratch_path(spark, "store"), chunk_size=CHUNK_SIZE)
    return st.read_store(spark, path)


@register("store_roundtrip", with_frames(f"SELECT {RAW_COLS}, ordinal // {CHUNK_SIZE} AS chunk_id FROM frames"))
def q_store_roundtrip(spark, sf):
    """Any frames → chunked Parquet store → read back equal."""
    s = _store(spark, sf)
    return s.select(*_raw_exprs(), F.col("chunk_id").cast("bigint"))


@register("lookup_time_range", with_frames(
    f"SELECT trace_id, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, COUNT(*) > 0 AS matched "
    f"FROM frames WHERE timestamp_ns BETWEEN {T_JAN10} AND {T_JAN20} GROUP BY trace_id"))
def q_lookup_time_range(spark, sf):
    return st.lookup_time_range(_store(spark, sf), T_JAN10, T_JAN20)


@register("lookup_id", with_frames("SELECT trace_id, ordinal FROM frames WHERE can_id = 259"))
def q_lookup_id(spark, sf):
    return st.lookup_id(_store(spark, sf), 259)


@register("lookup_ordinal", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE ordinal = 777"))
def q_lookup_ordinal(spark, sf):
    return raw_out(st.lookup_ordinal(_store(spark, sf), 777))


_CHUNKS_SQL = (
    f"SELECT trace_id, ordinal // {CHUNK_SIZE} AS chunk_id, COUNT(*) AS event_count, "
    f"arg_min(timestamp_ns, ordinal) AS first_timestamp_ns, arg_max(timestamp_ns, ordinal) AS last_timestamp_ns, "
    f"array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels FROM frames GROUP BY 1, 2")


@register("chunk_summary", with_frames(_CHUNKS_SQL))
def q_chunk_summary(spark, sf):
    c = st.build_chunk_summary(_store(spark, sf), CHUNK_SIZE)
    return c.select("trace_id", "chunk_id", "event_count", "first_timestamp_ns", "last_timestamp_ns",
                    F.array_join(F.transform("channels", lambda x: x.cast("string")), ",").alias("channels"))


@register("cache_summary", with_frames(
    f", chunks AS ({_CHUNKS_SQL}) SELECT trace_id, CAST(sum(event_count) AS BIGINT) AS event_count, "
    "arg_min(first_timestamp_ns, chunk_id) AS start_timestamp_ns, arg_max(last_timestamp_ns, chunk_id) AS "
    "end_timestamp_ns, COUNT(*) AS chunk_count FROM chunks GROUP BY trace_id"))
def q_cache_summary(spark, sf):
    return st.store_summary(st.build_chunk_summary(_store(spark, sf), CHUNK_SIZE))


@register("chunk_skip", with_frames(
    f"SELECT {RAW_COLS} FROM frames WHERE timestamp_ns BETWEEN {T_JAN10} AND {T_JAN20} AND channel = 1"))
def q_chunk_skip(spark, sf):
    """Only chunks overlapping the time range and holding the channel are read."""
    s = _store(spark, sf)
    return raw_out(st.store_range(s, T_JAN10, T_JAN20, channel=1))


# --------------------------------------------------------------------------- sinks (K1-K7)

_CSV_STR = "timestamp_ns string, channel string, can_id string, dlc string, payload string, frame_type string"
_DEC_STR = "timestamp_ns string, can_id string, message_name string, signal_name string, signal_value string, unit string"
_SPACED = ("CASE WHEN can_id = 259 THEN printf('%02X %02X', raw % 256, raw // 256) ELSE "
           "printf('%02X %02X %02X %02X %02X %02X %02X %02X', raw % 256, raw // 256, user_id % 256, "
           "event_id % 2 + 2 * (user_id % 128), raw // 256, raw % 256, event_id % 256, (event_id // 256) % 256) END")


@register("export_raw_csv", with_frames(
    f"SELECT CAST(timestamp_ns AS VARCHAR) AS timestamp_ns, CAST(channel AS VARCHAR) AS channel, "
    f"printf('%X', can_id) AS can_id, CAST(dlc AS VARCHAR) AS dlc, {_SPACED} AS payload, "
    "CASE WHEN frame_type = 1 THEN 'FD' ELSE 'CAN' END AS frame_type FROM frames WHERE can_id IN (256, 259)"))
def q_export_raw_csv(spark, sf):
    """Raw CSV written by Spark, read back as text columns."""
    path = scratch_path(spark, "export-raw")
    ex.export_raw_csv(run_query(frames(spark, sf), raw_filter=any_of(Pred("can_id", "eq", 256),
                                                                       Pred("can_id", "eq", 259))), path)
    return spark.read.option("header", "true").schema(_CSV_STR).csv(path)


@register("export_no_header", with_frames(
    f"SELECT CAST(timestamp_ns AS VARCHAR) AS timestamp_ns, CAST(channel AS VARCHAR) AS channel, "
    f"printf('%X', can_id) AS can_id, CAST(dlc AS VARCHAR) AS dlc, {_SPACED} AS payload, "
    "CASE WHEN frame_type = 1 THEN 'FD' ELSE 'CAN' END AS frame_type FROM frames WHERE can_id = 259"))
def q_export_no_header(spark, sf):
    """K3: raw CSV without a header, every line read back as data."""
    path = scratch_path(spark, "export-raw")
    ex.export_raw_csv(run_query(frames(spark, sf), raw_filter=Pred("can_id", "eq", 259)), path, header=False)
    return spark.read.schema(_CSV_STR).csv(path)


@register("export_decoded_csv", with_signals(
    "SELECT CAST(timestamp_ns AS VARCHAR) AS timestamp_ns, printf('%X', can_id) AS can_id, message_name, "
    "signal_name, printf('%.6G', value) AS signal_value, unit FROM signals WHERE can_id IN (258, 259)"))
def q_export_decoded_csv(spark, sf):
    """K2/K4: decoded CSV, one row per signal, values printed with 6 significant digits."""
    path = scratch_path(spark, "export-dec")
    dec = decode_long(run_query(frames(spark, sf), raw_filter=Pred("can_id", "ge", 258)), events_dbc(spark))
    ex.export_decoded_csv(dec, path)
    back = spark.read.option("header", "true").schema(_DEC_STR).csv(path)
    return back.withColumn("unit", F.coalesce("unit", F.lit("")))


@register("export_parquet", with_signals(f"SELECT {LONG_COLS} FROM signals"))
def q_export_parquet(spark, sf):
    """K6: columnar export of the decoded long table."""
    path = scratch_path(spark, "export-parquet")
    ex.export_parquet(long_out(_long(spark, sf)), path)
    return spark.read.parquet(path)


@register("render_text", with_frames(
    "SELECT ordinal, printf('[%d] ts=%d can_id=0x%X dlc=%d ch=%d data=%s', ordinal, timestamp_ns, can_id, dlc, "
    f"channel, {_SPACED}) AS text FROM frames WHERE can_id = 259"))
def q_render_text(spark, sf):
    """The printed frame line."""
    fr = run_query(frames(spark, sf), raw_filter=Pred("can_id", "eq", 259))
    return ex.render_frame_text(fr).select(F.col("ordinal").cast("bigint"), "text")


@register("render_signal_text", with_signals(
    "SELECT ordinal, signal_index, signal_name || ' = ' || printf('%.6G', value) || "
    "COALESCE(' (' || value_description || ')', '') || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END AS text "
    "FROM signals WHERE can_id IN (256, 259)"))
def q_render_signal_text(spark, sf):
    """K7: ``name = value (label) unit`` lines of decoded signals."""
    dec = decode_long(run_query(frames(spark, sf), raw_filter=any_of(Pred("can_id", "eq", 256),
                                                                      Pred("can_id", "eq", 259))), events_dbc(spark))
    return ex.render_signal_text(dec).select(F.col("ordinal").cast("bigint"), F.col("signal_index").cast("bigint"),
                                             "text")


# --------------------------------------------------------------------------- dictionary

_USERS = "(SELECT DISTINCT user_id AS u FROM events)"


def _users_dbc(spark, sf) -> Dbc:
    return load_dbc(spark, write_users_dbc(spark, sf, scratch_path(spark, "users-dbc")))


@register("dbc_messages", (
    "SELECT CAST(1024 + u AS BIGINT) AS can_id, 'User' || u || CASE WHEN u % 10 = 0 THEN 'b' ELSE '' END "
    f"AS message_name, CAST(CASE WHEN u % 10 = 0 THEN 4 ELSE 8 END AS BIGINT) AS dlc FROM {_USERS}"))
def q_dbc_messages(spark, sf):
    """Messages, last definition per id wins, other keywords ignored."""
    d = _users_dbc(spark, sf)
    return d.messages.select("can_id", "message_name", F.col("dlc").cast("bigint"))


_SIG_COLS = ("can_id, signal_index, signal_name, is_multiplexer, multiplex_value, start_bit, bit_length, "
             "little_endian, is_signed, scale, \"offset\", minimum, maximum, unit")


def _sig_sql(idx, name, mux, mval, start, length, signed, scale, offset, mn, mx, unit, where):
    return (f"SELECT CAST(1024 + u AS BIGINT) AS can_id, CAST({idx} AS BIGINT) AS signal_index, '{name}' AS signal_name, "
            f"{mux} AS is_multiplexer, CAST({mval} AS BIGINT) AS multiplex_value, CAST({start} AS BIGINT) AS start_bit, "
            f"CAST({length} AS BIGINT) AS bit_length, true AS little_endian, {signed} AS is_signed, "
            f"{scale}::DOUBLE AS scale, {offset}::DOUBLE AS \"offset\", {mn}::DOUBLE AS minimum, {mx}::DOUBLE AS maximum, "
            f"'{unit}' AS unit FROM {_USERS} WHERE {where}")


@register("dbc_signals", " UNION ALL ".join([
    _sig_sql(0, "Amount", "false", "NULL", 0, 16, "false", "0.01", "0", "0", "655.35", "u", "u % 10 <> 0"),
    _sig_sql(1, "Kind", "true", "NULL", 16, 8, "false", "1", "0", "0", "4", "", "u % 10 <> 0"),
    _sig_sql(2, "Extra", "false", "u % 3", 24, 8, "true", "0.5", "-1", "-65", "62.5", "deg", "u % 10 <> 0"),
    _sig_sql(0, "Amount", "false", "NULL", 0, 16, "false", "0.1", "0", "0", "6553.5", "u", "u % 10 = 0"),
]))
def q_dbc_signals(spark, sf):
    """Signals with multiplex markers, attached to their (active) message."""
    d = _users_dbc(spark, sf)
    return d.signals.select(
        "can_id", F.col("signal_index").cast("bigint"), "signal_name", "is_multiplexer", "multiplex_value",
        F.col("start_bit").cast("bigint"), F.col("bit_length").cast("bigint"), "little_endian", "is_signed",
        "scale", "offset", "minimum", "maximum", "unit")


@register("dbc_labels", (
    f"SELECT CAST(1024 + u AS BIGINT) AS can_id, 'Kind' AS signal_name, CAST(k AS BIGINT) AS raw_value, label "
    f"FROM {_USERS}, (VALUES (0, 'click'), (1, 'view'), (2, 'purchase'), (3, 'signup'), (4, 'error'), (-1, 'none 7 ')) AS l(k, label) "
    "WHERE u % 10 <> 0"))
def q_dbc_labels(spark, sf):
    """Value labels; labels of a superseded definition do not carry over."""
    return _users_dbc(spark, sf).labels.select("can_id", "signal_name", "raw_value", "label")


@register("dbc_last_wins", (
    "SELECT CAST(1024 + u AS BIGINT) AS can_id, CAST(CASE WHEN u % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_definitions,"
    f" 'User' || u || CASE WHEN u % 10 = 0 THEN 'b' ELSE '' END AS active_name FROM {_USERS}"))
def q_dbc_last_wins(spark, sf):
    """Every definition is listed; the active one is the last."""
    d = _users_dbc(spark, sf)
    n = d.all_messages.groupBy("can_id").agg(F.count(F.lit(1)).alias("n_definitions"))
    return n.join(d.messages.select("can_id", F.col("message_name").alias("active_name")), "can_id")


# --------------------------------------------------------------------------- hooks

def _odd_id_not_ch1(ts, can_id, channel, dlc):
    return (can_id % 2 == 1) & (channel != 1)


def _p_or_view(name):
    return name.str.startswith("P") | (name == "View")


@register("hook_frame", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE can_id % 2 = 1 AND channel <> 1"))
def q_hook_frame(spark, sf):
    """A Python frame predicate, run as an Arrow-batched pandas UDF."""
    return raw_out(run_query(frames(spark, sf), frame_hook=hooks.frame_hook(_odd_id_not_ch1)))


@register("hook_frame_expr", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE dlc = 8 AND channel IN (0, 2)"))
def q_hook_frame_expr(spark, sf):
    """An SQL-expression hook (JVM side); a disabled hook accepts all."""
    hook = hooks.frame_hook(expr="dlc = 8 AND channel IN (0, 2)") & hooks.frame_hook(_odd_id_not_ch1, enabled=False)
    return raw_out(run_query(frames(spark, sf), frame_hook=hook))


@register("hook_decoded", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE can_id IN (257, 258)"))
def q_hook_decoded(spark, sf):
    """A Python predicate on the decoded message name."""
    return raw_out(run_query(frames(spark, sf), dbc=events_dbc(spark), decoded_hook=hooks.decoded_hook(_p_or_view)))


@register("hook_transform", with_signals(
    "SELECT ordinal, value, value * 2.0::DOUBLE AS value_x2 FROM signals WHERE signal_name = 'EvtValue'"))
def q_hook_transform(spark, sf):
    """U4: a DataFrame → DataFrame transform hook."""
    dec = _long(spark, sf).filter(F.col("signal_name") == "EvtValue")
    out = hooks.transform_hook(dec, lambda df: df.withColumn("value_x2", F.col("value") * 2.0))
    return out.select(F.col("ordinal").cast("bigint"), "value", "value_x2")


# --------------------------------------------------------------------------- sessions

def _session(spark, sf) -> TraceSession:
    return TraceSession(frames(spark, sf), events_dbc(spark), decode=True)


@register("refine", _decoded_frames_sql(
    "f.channel = 1 AND EXISTS (SELECT 1 FROM signals s WHERE s.ordinal = f.ordinal AND s.value > 300.0::DOUBLE)"))
def q_refine(spark, sf):
    """Scan once, filter the full set, then refine the current matches."""
    s = _session(spark, sf)
    s.filter_full(raw_filter=Pred("channel", "eq", 1))
    return _decoded_out(s.refine(decoded_filter=Pred("signal_value", "gt", 300.0)))


@register("session_rows", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE can_id = 260 AND channel = 0"))
def q_session_rows(spark, sf):
    """Reset to the full set; undecoded rows are kept in a session; a reversed
    ordinal range is ignored by the session row test."""
    s = _session(spark, sf)
    s.filter_full(raw_filter=Pred("can_id", "eq", 256))
    s.reset()
    return raw_out(s.filter_full(raw_filter=all_of(Pred("can_id", "eq", 260), Pred("channel", "eq", 0)),
                                 ordinal_start=500, ordinal_end=100))


# --------------------------------------------------------------------------- streaming

@register("stream_ingest_decode", with_signals(
    f"SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, CAST(ordinal // {TRACE_FILES} AS BIGINT) AS ordinal, "
    "can_id, signal_name, raw_value, value FROM signals"))
def q_stream_ingest_decode(spark, sf):
    """Arriving CSV traces → file stream → per-batch parse + decode → Parquet sink."""
    glob = _written(spark, sf, "csv", noise_every=50)
    out, _progress = run_trace_stream_once(spark, glob, "csv", scratch_path(spark, "stream-out"),
                                           scratch_path(spark, "stream-ckpt"), dbc=events_dbc(spark))
    return out.select(_bucket(), F.col("ordinal").cast("bigint"), F.col("can_id").cast("bigint"), "signal_name",
                      F.col("raw_value").cast("bigint"), "value")



@register("ingest_exact_time", with_frames(
    f"SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, CAST(ordinal // {TRACE_FILES} AS BIGINT) AS ordinal, "
    f"timestamp_ns - {TEXT_EPOCH_NS} AS timestamp_ns, can_id, dlc, channel, CAST(0 AS BIGINT) AS frame_type, "
    "payload_hex FROM frames"))
def q_ingest_exact_time(spark, sf):
    """X1 exact: seconds text parsed as a decimal keeps every nanosecond."""
    return ingest_out(read_trace(spark, _written(spark, sf, "candump"), fmt="candump", exact_time=True))


@register("read_chunk", with_frames(f"SELECT {RAW_COLS} FROM frames WHERE ordinal // {CHUNK_SIZE} = 3"))
def q_read_chunk(spark, sf):
    """One chunk of a saved trace (row groups of other chunks are skipped)."""
    return raw_out(st.read_chunk(_store(spark, sf), 3))


@register("dbc_lookup_name", (
    f"SELECT CAST(1024 + u AS BIGINT) AS can_id, 'User' || u AS message_name, CAST(8 AS BIGINT) AS dlc "
    f"FROM {_USERS} WHERE u = 7"))
def q_dbc_lookup_name(spark, sf):
    """Exact, case-sensitive lookup by name (last definition of the name wins)."""
    d = _users_dbc(spark, sf)
    return d.message_by_name("User7").select("can_id", "message_name", F.col("dlc").cast("bigint"))


@register("stream_progress", with_signals(
    f"SELECT COUNT(*) AS rows_written, CAST({TRACE_FILES} AS BIGINT) AS files FROM signals"))
def q_stream_progress(spark, sf):
    """Per-batch progress of the stream (rows written, files), summed over batches."""
    glob = _written(spark, sf, "csv")
    _out, progress = run_trace_stream_once(spark, glob, "csv", scratch_path(spark, "stream-out"),
                                           scratch_path(spark, "stream-ckpt"), dbc=events_dbc(spark))
    rows = [(int(p["batch_id"]), int(p["files"]), int(p["rows_written"])) for p in progress]
    df = spark.createDataFrame(rows, "batch_id bigint, files bigint, rows_written bigint")
    return df.agg(F.sum("rows_written").cast("bigint").alias("rows_written"), F.sum("files").cast("bigint").alias("files"))


_CSV_LINE = (f"CASE WHEN ordinal % 97 = 96 THEN 8 ELSE length(printf('%d.%09d,%d,%X,%d,', (timestamp_ns - {TEXT_EPOCH_NS}) // 1000000000, "
             f"(timestamp_ns - {TEXT_EPOCH_NS}) % 1000000000, channel, can_id, dlc)) + 3 * dlc - 1 + CASE frame_type WHEN 1 THEN 3 ELSE 4 END END")


@register("stream_metrics", with_frames(
    f"SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, count_if(ordinal % 97 <> 96) AS scanned, count_if(ordinal % 97 <> 96 AND can_id = 257) AS matched, "
    f"count_if(ordinal % 97 = 96) AS rejected, count(*) + 1 AS lines, CAST(sum({_CSV_LINE} + 1) + 48 AS BIGINT) AS bytes, count_if(ordinal % 97 <> 96 AND can_id = 257) AS rows_written, "
    f"count_if(ordinal % 97 = 96) AS rejected_rows FROM frames GROUP BY 1"))
def q_stream_metrics(spark, sf):
    """Observed metrics of each batch (one file each): scanned, matched, rejected, lines, bytes; and the written rows."""
    glob = _written(spark, sf, "csv", broken_every=97)
    out_path = scratch_path(spark, "stream-out")
    out, progress = run_trace_stream_once(spark, glob, "csv", out_path, scratch_path(spark, "stream-ckpt"), raw_filter=Pred("can_id", "eq", 257), max_files_per_trigger=1)
    names = ["scanned", "matched", "rejected", "lines", "bytes", "rows_written"]
    told = spark.createDataFrame([(p["batch_id"], *(p[n] for n in names)) for p in progress], "batch bigint, " + ", ".join(f"{n} bigint" for n in names))
    lost = spark.read.parquet(out_path + "-rejected")
    files = out.select("batch", _bucket()).unionByName(lost.select("batch", _bucket())).distinct()
    per_file = lost.groupBy("batch").agg(F.count(F.lit(1)).alias("rejected_rows"))
    return told.join(files, "batch").join(per_file, "batch", "left").select("bucket", *names, F.coalesce("rejected_rows", F.lit(0)).alias("rejected_rows"))


# --------------------------------------------------------------------------- many signals, several traces, options

def _users_frames(spark, sf) -> DataFrame:
    """The fixture frames with the id of their user's message (``users_dbc_lines``)."""
    users = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("ordinal"), (F.col("user_id") + 1024).cast("bigint").alias("can_id"))
    fr = frames(spark, sf)
    return fr.drop("can_id").join(users, "ordinal").select(*fr.columns)


_MANY = with_frames(f"""SELECT * FROM (
    WITH d AS (SELECT ordinal, CAST(1024 + user_id AS BIGINT) AS can_id, user_id AS u, raw, CAST(CASE WHEN dlc = 2 THEN 0 ELSE user_id % 256 END AS BIGINT) AS b2,
                      CAST(CASE WHEN dlc = 2 THEN 0 ELSE event_id % 2 + 2 * (user_id % 128) END AS BIGINT) AS b3 FROM frames)
    SELECT ordinal, can_id, 'User' || u || CASE WHEN u % 10 = 0 THEN 'b' ELSE '' END AS message_name, 0::BIGINT AS signal_index, 'Amount' AS signal_name, raw AS raw_value,
           raw::DOUBLE * CASE WHEN u % 10 = 0 THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END + 0.0::DOUBLE AS value, 'u' AS unit, NULL::VARCHAR AS value_description FROM d
    UNION ALL SELECT ordinal, can_id, 'User' || u, 1, 'Kind', b2, b2::DOUBLE, '', CASE b2 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' WHEN 4 THEN 'error' END FROM d WHERE u % 10 <> 0
    UNION ALL SELECT ordinal, can_id, 'User' || u, 2, 'Extra', b3, (CASE WHEN b3 >= 128 THEN b3 - 256 ELSE b3 END)::DOUBLE * 0.5::DOUBLE - 1.0::DOUBLE, 'deg', NULL FROM d WHERE u % 10 <> 0 AND b2 = u % 3)""")


@register("decode_many_long", _MANY)
def q_decode_many_long(spark, sf):
    """A dictionary of three signals a user (over the bound of compiled ones), by the generic program."""
    return long_out(decode_long(_users_frames(spark, sf), _users_dbc(spark, sf), strategy="join"))


@register("decode_many_nested", _MANY)
def q_decode_many_nested(spark, sf):
    """The same as nested rows, a slot for each signal of a message."""
    return long_out(explode_signals(decode_nested(_users_frames(spark, sf), _users_dbc(spark, sf), strategy="join")))


def _event_traces(spark, sf, **kw) -> DataFrame:
    """The fixture as four traces with ordinals of their own."""
    return read_trace(spark, _written(spark, sf, "csv"), fmt="csv", **kw)


_TRACES = f"t AS (SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, ordinal // {TRACE_FILES} AS o, can_id, channel FROM frames)"


@register("early_stop_traces", (
    f"WITH {FRAMES_CTE}, {_TRACES}, r AS (SELECT bucket, o, row_number() OVER (PARTITION BY bucket ORDER BY o) AS n FROM t WHERE can_id <= 257) "
    "SELECT t.bucket, coalesce(max(r.o) + 1, count(*)) AS scanned, CAST(least(700, count_if(t.can_id <= 257)) AS BIGINT) AS matched "
    "FROM t LEFT JOIN r ON r.bucket = t.bucket AND r.n = 700 GROUP BY t.bucket"))
def q_early_stop_traces(spark, sf):
    """A1 with L2: each of several traces stops at its own match."""
    return early_stop_counts(_event_traces(spark, sf), F.col("can_id") <= 257, 700).select(_bucket(), "scanned", "matched")


@register("context_traces", (
    f"WITH {FRAMES_CTE}, {_TRACES} SELECT m.bucket, m.o AS match_ordinal, c.o AS ordinal, c.o - m.o AS rel_pos, c.can_id "
    "FROM t AS m JOIN t AS c ON c.bucket = m.bucket AND c.o BETWEEN m.o - 2 AND m.o + 3 WHERE m.can_id = 259 AND m.channel = 1"))
def q_context_traces(spark, sf):
    """C3 over several traces: windows stay within their trace."""
    fr = _event_traces(spark, sf)
    found = ctx.context_of_matches(fr, run_query(fr, raw_filter=all_of(Pred("can_id", "eq", 259), Pred("channel", "eq", 1))), 2, 3)
    return found.select(_bucket(), "match_ordinal", "ordinal", "rel_pos", F.col("can_id").cast("bigint"))


@register("decode_extended_ids", with_signals(f"SELECT {LONG_COLS} FROM signals"))
def q_decode_extended_ids(spark, sf):
    """Q8: ids marked as 29-bit ones decode when the mark is taken off."""
    marked = re.sub(r"^(BO_|VAL_) (\d+)", lambda m: f"{m[1]} {int(m[2]) + (1 << 31)}", EVENTS_DBC, flags=re.M)
    d = load_dbc(spark, write_dbc_text(spark, marked, scratch_path(spark, "dbc")), strip_extended_flag=True)
    return long_out(decode_long(frames(spark, sf), d))


@register("decode_signed_labels", with_signals(
    "SELECT ordinal, raw_value, value, CASE raw_value WHEN 130 THEN 'below' WHEN 5 THEN 'above' END AS value_description FROM signals WHERE signal_name = 'UserTag'"))
def q_decode_signed_labels(spark, sf):
    """Q10: labels of negative values of a signed signal are found."""
    text = EVENTS_DBC + "".join(f'VAL_ {i} UserTag -126 "below" 5 "above" ;\n' for i in (256, 257, 258))
    d = load_dbc(spark, write_dbc_text(spark, text, scratch_path(spark, "dbc")), signed_labels=True)
    return long_out(decode_long(frames(spark, sf), d)).filter("signal_name = 'UserTag'").select("ordinal", "raw_value", "value", "value_description")


@register("ingest_full_channel", with_frames(
    f"SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, ordinal // {TRACE_FILES} AS ordinal, channel + 10 AS channel, payload_hex FROM frames"))
def q_ingest_full_channel(spark, sf):
    """Q21: the whole number of a candump interface is the channel."""
    fr = frames(spark, sf).withColumn("channel", F.col("channel") + 10)
    glob = write_text_trace(fr, scratch_path(spark, "trace-candump"), "candump", files=trace_files(spark, sf))
    return ingest_out(read_trace(spark, glob, fmt="candump", full_channel=True)).select("bucket", "ordinal", "channel", "payload_hex")


@register("scan_stats", with_frames(
    f"SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, count(*) + 1 AS lines, count_if(ordinal % 97 <> 96) AS frames, count_if(ordinal % 97 = 96) AS rejected, "
    f"CAST(sum({_CSV_LINE} + 1) + 48 AS BIGINT) AS bytes_consumed, 'csv' AS source_format FROM frames GROUP BY 1"))
def q_scan_stats(spark, sf):
    """What a whole scan of each trace consumed."""
    return scan_stats(spark, _written(spark, sf, "csv", broken_every=97), "csv").select(_bucket(), "lines", "frames", "rejected", "bytes_consumed", "source_format")


@register("ingest_strict_error", with_frames(
    f"SELECT CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket, min(ordinal // {TRACE_FILES}) + 2 AS line_no, 'bad,line' AS text FROM frames WHERE ordinal % 97 = 96 GROUP BY 1"))
def q_ingest_strict_error(spark, sf):
    """The strict error of each trace names the first bad line and its text."""
    glob = _written(spark, sf, "csv", broken_every=97)
    found = []
    for k in range(trace_files(spark, sf)):
        try:
            read_trace(spark, glob.replace("bucket=*", f"bucket={k}"), fmt="csv")
        except TraceParseError as e:
            found.append((k, e.line, e.text))
    return spark.createDataFrame(found, "bucket bigint, line_no bigint, text string")


@register("callback_batches", with_frames("SELECT COUNT(*) AS rows, CAST(sum(ordinal) AS BIGINT) AS handled FROM frames WHERE can_id = 258"))
def q_callback_batches(spark, sf):
    """K5: matches handed out as Arrow batches, counted by what the tasks committed."""
    found = run_query(frames(spark, sf), raw_filter=Pred("can_id", "eq", 258)).select("ordinal")
    ledger = ex.for_each_batch(found, lambda batch, partition, attempt: sum(batch.column("ordinal").to_pylist()))
    return ledger.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("handled").alias("handled"))


# --------------------------------------------------------------------------- float signals

def _float_dbc(spark) -> Dbc:
    """A hand-made dictionary (text DBCs cannot declare float signals, Q7): message 257
    carries the first four payload bytes as float32 and all eight as float64, both
    little-endian; scale and offset are set but must not be applied (P6)."""
    key = ("float", spark.sparkContext.applicationId)
    if key not in _DBC_CACHE:
        msgs = spark.createDataFrame([(257, "FloatView", 8, 0)],
                                     "can_id bigint, message_name string, dlc int, def_index bigint")
        sigs = spark.createDataFrame(
            [(257, 0, 0, "F32", False, None, 0, 32, True, False, "float32", 3.0, 1.0, 0.0, 0.0, ""),
             (257, 0, 1, "F64", False, None, 0, 64, True, False, "float64", 3.0, 1.0, 0.0, 0.0, "")],
            "can_id bigint, def_index bigint, signal_index int, signal_name string, is_multiplexer boolean, "
            "multiplex_value bigint, start_bit int, bit_length int, little_endian boolean, is_signed boolean, "
            "value_type string, scale double, offset double, minimum double, maximum double, unit string")
        labels = spark.createDataFrame([], "can_id bigint, signal_name string, raw_value bigint, label string")
        probs = spark.createDataFrame([], "file_path string, line_no bigint, message string")
        _DBC_CACHE[key] = Dbc(msgs, sigs, labels, msgs.withColumn("def_file", F.lit("")), probs)
    return _DBC_CACHE[key]


# The little-endian bit pattern of the fixture payload of view frames, as DuckDB arithmetic.
_B = ["raw % 256", "raw // 256", "user_id % 256", "(event_id % 2 + 2 * (user_id % 128))", "raw // 256",
      "raw % 256", "event_id % 256", "(event_id // 256) % 256"]
_BITS32 = " + ".join(f"CAST({b} AS HUGEINT) * {1 << (8 * i)}" for i, b in enumerate(_B[:4]))
_BITS64 = " + ".join(f"CAST({b} AS HUGEINT) * {1 << (8 * i)}" for i, b in enumerate(_B))


def _ieee_sql(bits: str, e_bits: int, m_bits: int) -> str:
    bias, emax = (1 << (e_bits - 1)) - 1, (1 << e_bits) - 1
    total = e_bits + m_bits
    sign = f"(CASE WHEN (({bits}) >> {total}) & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"
    e = f"CAST(((({bits}) >> {m_bits}) & {emax}) AS BIGINT)"
    m = f"CAST((({bits}) & {(1 << m_bits) - 1}) AS DOUBLE)"
    return (f"CASE WHEN {e} = {emax} AND {m} = 0 THEN {sign} * 'inf'::DOUBLE WHEN {e} = {emax} THEN 'nan'::DOUBLE "
            f"WHEN {e} = 0 THEN {sign} * {m} * {2.0 ** (1 - bias - m_bits)!r}::DOUBLE "
            f"ELSE {sign} * (1.0::DOUBLE + {m} / {float(1 << m_bits)!r}::DOUBLE) * pow(2.0::DOUBLE, "
            f"CAST({e} - {bias} AS DOUBLE)) END")


@register("decode_float32", with_frames(
    f"SELECT ordinal, CAST({_BITS32} AS BIGINT) AS raw_value, {_ieee_sql(_BITS32, 8, 23)} AS value "
    "FROM frames WHERE can_id = 257"))
def q_decode_float32(spark, sf):
    """IEEE float32 bit-cast (scale/offset not applied)."""
    d = decode_long(frames(spark, sf), _float_dbc(spark)).filter(F.col("signal_name") == "F32")
    return d.select(F.col("ordinal").cast("bigint"), F.col("raw_value").cast("bigint"), "value")


@register("decode_float64", with_frames(
    f"SELECT ordinal, {_ieee_sql(_BITS64, 11, 52)} AS value FROM frames WHERE can_id = 257"))
def q_decode_float64(spark, sf):
    """IEEE float64 bit-cast of the whole 8-byte payload."""
    d = decode_long(frames(spark, sf), _float_dbc(spark)).filter(F.col("signal_name") == "F64")
    return d.select(F.col("ordinal").cast("bigint"), "value")


# --------------------------------------------------------------------------- listings, errors, order, counts of sinks

from ..errors import DecodeError  # noqa: E402
from ..sources.fixtures import write_flawed_dbc  # noqa: E402
from ..sources.traces import classify_paths, discover_traces  # noqa: E402

_BUCKET_SQL = f"CAST(ordinal % {TRACE_FILES} AS BIGINT) AS bucket"


@register("ingest_by_extension", _ingest_sql(frame_type="0"))
def q_ingest_by_extension(spark, sf):
    """No format given; the files' extension names it."""
    return ingest_out(read_trace(spark, _written(spark, sf, "candump") + ".txt"))


_EXTENSIONS = {".log": "candump", ".CSV": "csv", ".asc": "asc", ".BLF": None, ".mf4": None, ".bin": None, "": None}
_KNOWN = {".BLF": "BLF", ".mf4": "MF4"}


@register("classify_formats", with_frames(
    "SELECT ordinal, CASE ordinal % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_EXTENSIONS.values()) if v)
    + " END AS source_format, CASE ordinal % 7 " + " ".join(f"WHEN {k} THEN '{_KNOWN[e]}'" for k, e in enumerate(_EXTENSIONS) if e in _KNOWN)
    + " END AS known_format FROM frames"))
def q_classify_formats(spark, sf):
    """Readable, recognised and unknown extensions of a table of paths."""
    ext = F.get(F.array(*[F.lit(e) for e in _EXTENSIONS]), F.pmod("ordinal", F.lit(len(_EXTENSIONS))).cast("int"))
    paths = frames(spark, sf).select(F.col("ordinal").cast("bigint"), F.concat(F.lit("run.1/t"), "ordinal", ext).alias("path"))
    return classify_paths(paths).select("ordinal", "source_format", "known_format")


_CANDUMP_SQL = (f"printf('(%d.%09d) can%d %X#', (timestamp_ns - {TEXT_EPOCH_NS}) // 1000000000, "
                f"(timestamp_ns - {TEXT_EPOCH_NS}) % 1000000000, channel, can_id) || payload_hex")


def _with_empty_file(spark, glob: str) -> str:
    """The folder of a written trace, with a file of no bytes (bucket 9) beside the others."""
    folder = glob.split("/bucket=")[0]
    write_shared_bytes(spark, f"{folder}/bucket=9/part-none.txt", b"")
    return folder


@register("discover_traces", with_frames(
    f"SELECT {_BUCKET_SQL}, 'txt' AS extension, CAST(sum(length({_CANDUMP_SQL}) + 1) AS BIGINT) AS size_bytes FROM frames GROUP BY 1 UNION ALL SELECT 9, 'txt', 0"))
def q_discover_traces(spark, sf):
    """The trace files below a folder with their sizes, one of no bytes too."""
    found = discover_traces(spark, _with_empty_file(spark, _written(spark, sf, "candump")))
    return found.select(_bucket("path"), "extension", "size_bytes")


@register("trace_metadata_empty", with_frames(
    f"SELECT {_BUCKET_SQL}, count_if(ordinal % 4 <> 3) AS event_count, arg_min({_TS_SQL}, ordinal) FILTER (WHERE ordinal % 4 <> 3) "
    f"AS start_timestamp_ns, arg_max({_TS_SQL}, ordinal) FILTER (WHERE ordinal % 4 <> 3) AS end_timestamp_ns, "
    "'csv' AS source_format FROM frames GROUP BY 1 UNION ALL SELECT 9, 0, NULL, NULL, 'csv'"))
def q_trace_metadata_empty(spark, sf):
    """A trace without a readable record still has its row, one of no bytes too."""
    glob = _written(spark, sf, "csv", broken_every=4)
    folder = _with_empty_file(spark, glob)
    fr = read_trace(spark, glob, fmt="csv", mode="tolerant", keep_source=True)
    md = trace_metadata(fr, discover_traces(spark, folder), fmt="csv")
    return md.select(_bucket(), "event_count", "start_timestamp_ns", "end_timestamp_ns", "source_format")


@register("result_bounds_format", with_frames(
    f"SELECT {_BUCKET_SQL}, COUNT(*) AS row_count, min({_TS_SQL}) AS start_timestamp_ns, max({_TS_SQL}) AS end_timestamp_ns, "
    "'asc' AS source_format FROM frames WHERE can_id = 256 GROUP BY 1"))
def q_result_bounds_format(spark, sf):
    """A2: the bounds of a result of read traces name their format."""
    fr = read_trace(spark, _written(spark, sf, "asc"), fmt="asc", keep_source=True)
    found = summ.result_bounds(run_query(fr, raw_filter=Pred("can_id", "eq", 256)))
    return found.select(_bucket(), "row_count", "start_timestamp_ns", "end_timestamp_ns", "source_format")


@register("dbc_load_errors", (
    "SELECT CAST(u % 4 AS BIGINT) AS bucket, CAST(3 * n - CASE WHEN u % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS line_no, "
    "CASE WHEN u % 5 = 0 THEN 'SG_ line can''t be read' ELSE 'VAL_ line has a text without a number' END AS message "
    f"FROM (SELECT u, row_number() OVER (PARTITION BY u % 4 ORDER BY u) AS n FROM {_USERS}) WHERE u % 5 = 0 OR u % 3 = 0"))
def q_dbc_load_errors(spark, sf):
    """Every unreadable dictionary line, and every label without a number, with its line number."""
    d = load_dbc(spark, write_flawed_dbc(spark, sf, scratch_path(spark, "flawed-dbc")), strict=False)
    return d.problems.select(_bucket("file_path"), F.col("line_no").cast("bigint"), "message")


@register("decode_without_dictionary", with_frames(
    "SELECT can_id, COUNT(*) AS n_frames, 'DecodeError' AS error FROM frames GROUP BY can_id"))
def q_decode_without_dictionary(spark, sf):
    """Decoding without a dictionary is an error; the frames stay countable."""
    fr, error = frames(spark, sf), None
    try:
        decode_long(fr, None)
    except DecodeError as e:
        error = type(e).__name__
    return fr.groupBy("can_id").agg(F.count(F.lit(1)).alias("n_frames"), F.lit(error).alias("error")).withColumn(
        "can_id", F.col("can_id").cast("bigint"))


@register("ordered_output", with_frames(
    "SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS out_of_order FROM frames WHERE channel = 1"))
def q_ordered_output(spark, sf):
    """L1: rows come in source order, within the partitions of the result and between them."""
    rows = run_query(frames(spark, sf), raw_filter=Pred("channel", "eq", 1), ordered=True)
    placed = rows.select("ordinal", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("ordinal").over(Window.partitionBy("part").orderBy("at"))
    parts = placed.withColumn("wrong", F.coalesce(before > F.col("ordinal"), F.lit(False))).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("wrong"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    # One row per partition of the result, so one window over all of them is small.
    last = F.lag("hi").over(Window.orderBy("part"))
    return parts.withColumn("apart", F.coalesce(last > F.col("lo"), F.lit(False))).agg(
        F.sum("n").cast("bigint").alias("n_rows"), (F.sum("wrong") + F.count_if("apart")).cast("bigint").alias("out_of_order"))


@register("export_row_count", with_frames(
    "SELECT COUNT(*) AS rows_read, COUNT(*) AS rows_written FROM frames WHERE can_id = 258"))
def q_export_row_count(spark, sf):
    """The count an export returns, beside the rows found in its files."""
    path = scratch_path(spark, "export-count")
    n = ex.export_raw_csv(run_query(frames(spark, sf), raw_filter=Pred("can_id", "eq", 258)), path)
    back = spark.read.option("header", "true").schema(_CSV_STR).csv(path)
    return back.agg(F.count(F.lit(1)).alias("rows_read"), F.lit(n).cast("bigint").alias("rows_written"))


@register("callback_sink", with_frames(
    "SELECT COUNT(*) AS matches, COUNT(*) AS calls, CAST(sum(ordinal) AS BIGINT) AS ordinal_sum FROM frames WHERE can_id = 259"))
def q_callback_sink(spark, sf):
    """K5: one call per match on the executors, counted and summed there by accumulators."""
    found = run_query(frames(spark, sf), raw_filter=Pred("can_id", "eq", 259))
    calls, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def seen(row):
        calls.add(1)
        total.add(row["ordinal"])

    ex.for_each_match(found.select("ordinal"), seen)
    return found.agg(F.count(F.lit(1)).alias("matches"), F.lit(calls.value).cast("bigint").alias("calls"),
                     F.lit(total.value).cast("bigint").alias("ordinal_sum"))
