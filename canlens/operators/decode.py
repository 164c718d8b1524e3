"""Decode frames into signals.

Three strategies, chosen by the dictionary's checked size (``strategy="auto"``):

* compiled (``compiled.py``): a dictionary of at most ``MAX_COMPILED_SIGNALS`` signals
  becomes literal column expressions — no join at all, one codegen projection;
* one generic program over typed parameters (``program.py``), which frames meet by a broadcast
  join on ``can_id`` while the parameters are within bounds of rows and bytes (no shuffle of
  frames, and no skew problem even if one id carries a third of all frames);
* beyond that the same program by a shuffle join in which ids with many frames are *salted*: dealt to
  buckets by their counts, with their part of the dictionary replicated, so a hot id is spread over many tasks.

Two shapes:

* ``decode_nested``: one row per frame with ``message_name`` and ``signals`` (array of
  structs in dictionary order), so decoded filters (``exists``) need no regrouping.
  Dictionaries with a message of more than ``program.MAX_SLOTS`` signals build the array with
  ``filter``/``transform`` over the message's layout array.
* ``decode_long``: one row per (frame, active signal) — the canonical export shape.

Reference rules kept: the multiplexer selector is the first signal flagged ``M``; a
signal with a multiplex value is active only when the selector's raw value equals it (no
selector → dropped); labels are looked up by the raw unsigned value; frames whose id has
no definition are dropped (``keep_undecoded=True`` keeps them with nulls).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DecodeError
from ..functions.bits import payload_words, physical_value, raw_from_words
from ..plans.sizing import DEFAULT_MAX_BROADCAST_ROWS, checked_count
from ..sources.dbc import Dbc
from ..sources.lines import materialize
from . import program
from .compiled import compiled_layout, decode_nested_compiled

LAYOUT_FIELDS = [
    "signal_index", "signal_name", "is_multiplexer", "multiplex_value", "start_bit", "bit_length", "little_endian",
    "is_signed", "value_type", "scale", "offset", "unit",
]


def _selector(dbc: Dbc) -> DataFrame:
    """Layout of the first selector signal of each active message."""
    sel = dbc.signals.filter("is_multiplexer").groupBy("can_id").agg(
        F.min_by(F.struct("start_bit", "bit_length", "little_endian"), F.col("signal_index")).alias("sel"))
    return sel


def _label_maps(dbc: Dbc) -> DataFrame:
    return dbc.labels.groupBy("can_id", "signal_name").agg(
        F.map_from_entries(F.collect_list(F.struct("raw_value", "label"))).alias("labels"))


def signal_layouts(dbc: Dbc) -> DataFrame:
    """One row per active signal with its message name, selector layout and labels."""
    cached = getattr(dbc, "_signal_layouts", None)
    if cached is not None:
        return cached
    out = (
        dbc.signals.join(dbc.messages.select("can_id", "message_name"), "can_id")
        .join(_selector(dbc), "can_id", "left")
        .join(_label_maps(dbc), ["can_id", "signal_name"], "left")
    )
    out = dbc.keep(out.select("can_id", "message_name", *LAYOUT_FIELDS, "sel", "labels"))
    dbc._signal_layouts = out
    return out


def message_layouts(dbc: Dbc) -> DataFrame:
    """One row per active message: name, selector layout and the ordered signal array."""
    cached = getattr(dbc, "_message_layouts", None)
    if cached is not None:
        return cached
    sig = signal_layouts(dbc)
    per_msg = sig.groupBy("can_id", "message_name", "sel").agg(
        F.array_sort(
            F.collect_list(F.struct(*LAYOUT_FIELDS, "labels")),
            lambda a, b: F.when(a["signal_index"] < b["signal_index"], -1)
            .when(a["signal_index"] > b["signal_index"], 1).otherwise(0),
        ).alias("layout"))
    # Messages without signals still decode (to an empty list).
    out = dbc.messages.select("can_id", "message_name").join(
        per_msg.drop("message_name"), "can_id", "left"
    ).select("can_id", "message_name", "sel", F.coalesce("layout", F.array()).alias("layout"))
    dbc._message_layouts = out = dbc.keep(out)
    return out


MAX_PUSHED_IDS = 10_000


def _dictionary_ids(dbc: Dbc) -> list[int] | None:
    """The dictionary's ids when there are at most MAX_PUSHED_IDS (a bounded read)."""
    cached = getattr(dbc, "_pushed_ids", False)
    if cached is not False:
        return cached
    rows = dbc.messages.select("can_id").limit(MAX_PUSHED_IDS + 1).collect()
    ids = None if len(rows) > MAX_PUSHED_IDS else sorted(int(r["can_id"]) for r in rows)
    dbc._pushed_ids = ids
    return ids


def _join_dictionary(frames: DataFrame, table: DataFrame, how: str, broadcast: bool, salt_buckets: int,
                     ids: list[int] | None = None, condition: Column | None = None) -> DataFrame:
    if ids is not None and how == "inner":
        # Frames without a definition are dropped by the join anyway; saying so up front
        # lets the scan skip them (IN filter pushed to Parquet).
        frames = frames.filter(F.col("can_id").isin(ids))
    table = table.withColumnRenamed("can_id", "_dict_id")
    matching = F.col("can_id") == F.col("_dict_id")
    if condition is not None:
        matching = matching & condition
    if broadcast:
        return frames.join(F.broadcast(table), matching, how).drop("_dict_id")
    # Large dictionary: a shuffle join.  Ids with many frames are dealt to buckets by ordinal, as many as their share
    # asks for, and only their part of the dictionary is replicated.
    hot = F.broadcast(_hot_ids(frames, salt_buckets))
    spread = table.join(hot, F.col("_dict_id") == F.col("_hot_id"), "left")
    spread = spread.withColumn("_dict_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_buckets", F.lit(1)) - 1))).drop("_hot_id", "_buckets")
    keyed = frames.join(hot, F.col("can_id") == F.col("_hot_id"), "left")
    keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64("trace_id", "ordinal"), F.coalesce("_buckets", F.lit(1))).cast("int")).drop("_hot_id", "_buckets")
    return keyed.join(spread, matching & (F.col("_salt") == F.col("_dict_salt")), how).drop("_salt", "_dict_id", "_dict_salt")


def _hot_ids(frames: DataFrame, parts: int) -> DataFrame:
    """(_hot_id, _buckets): ids with more than half a part's frames, were all frames dealt to ``parts`` (fewer than twice as many ids)."""
    counts = materialize(frames.groupBy("can_id").agg(F.count(F.lit(1)).alias("n")), "id-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(1, total // (2 * parts))
    return counts.where(F.col("n") > share).select(F.col("can_id").alias("_hot_id"), F.ceil(F.col("n") / share).cast("int").alias("_buckets"))


def _with_words(frames: DataFrame) -> DataFrame:
    """Payload words once per frame (before the join, so not once per signal)."""
    be, le = payload_words(F.col("payload"))
    return frames.withColumn("_bew", be).withColumn("_lew", le)


def _raw(s_start: Column, s_len: Column, s_le: Column, motorola: bool = False) -> Column:
    return raw_from_words(F.col("_bew"), F.col("_lew"), F.length("payload"), s_start, s_len, s_le, motorola)


def _selector_raw(motorola: bool = False) -> Column:
    sel = F.col("sel")
    return F.when(sel.isNotNull(), _raw(sel["start_bit"], sel["bit_length"], sel["little_endian"], motorola))


def _require(dbc: Dbc | None) -> Dbc:
    if dbc is None:
        raise DecodeError("decoding needs a message dictionary")
    return dbc


def decode_nested(frames: DataFrame, dbc: Dbc | None, keep_undecoded: bool = False,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, salt_buckets: int = 64,
                  strategy: str = "auto", motorola: bool = False) -> DataFrame:
    """Frames + ``message_name`` + ``signals`` (array of active decoded signals).

    ``strategy``: ``"compiled"`` (dictionary as literal expressions, small dictionaries),
    ``"join"`` (broadcast or salted join), or ``"auto"`` (compiled when within bounds).
    ``motorola=True``: big-endian start bits use the standard DBC numbering (P3 option)."""
    dbc = _require(dbc)
    if strategy in ("auto", "compiled"):
        layout = compiled_layout(dbc, motorola)
        if layout is not None:
            return decode_nested_compiled(frames, layout, keep_undecoded)
        if strategy == "compiled":
            raise DecodeError("dictionary too large to compile; use strategy='join'")
    how = "left" if keep_undecoded else "inner"
    prog, ids = program.build(dbc, motorola), _dictionary_ids(dbc)
    broadcast = prog.broadcast and prog.rows <= max_broadcast_rows
    if prog.slots <= program.MAX_SLOTS:
        return program.decode_nested(frames, prog, lambda f, t: _join_dictionary(f, t, how, broadcast, salt_buckets, ids))
    joined = _join_dictionary(_with_words(frames), message_layouts(dbc), how, broadcast, salt_buckets, ids)
    joined = joined.withColumn("_sel_raw", _selector_raw(motorola))
    sel_raw = F.col("_sel_raw")
    active = F.filter(
        F.col("layout"),
        lambda s: s["multiplex_value"].isNull() | (sel_raw.isNotNull() & (s["multiplex_value"] == sel_raw)),
    )
    # First the raw values, then (separately, so the raw value is computed once) the rest.
    with_raw = F.transform(active, lambda s: F.struct(
        s["signal_index"].alias("signal_index"), s["signal_name"].alias("name"),
        _raw(s["start_bit"], s["bit_length"], s["little_endian"], motorola).alias("raw_value"),
        s["bit_length"].alias("bit_length"), s["is_signed"].alias("is_signed"), s["value_type"].alias("value_type"),
        s["scale"].alias("scale"), s["offset"].alias("offset"), s["unit"].alias("unit"), s["labels"].alias("labels"),
    ))
    joined = joined.withColumn("_sig_raw", with_raw)
    signals = F.transform(F.col("_sig_raw"), lambda s: F.struct(
        s["signal_index"].alias("signal_index"),
        s["name"].alias("name"),
        s["raw_value"].alias("raw_value"),
        physical_value(s["raw_value"], s["bit_length"], s["is_signed"], s["value_type"], s["scale"],
                       s["offset"]).alias("value"),
        s["unit"].alias("unit"),
        F.try_element_at(s["labels"], s["raw_value"]).alias("value_description"),
    ))
    # The signal array comes out of a one-row generator: a decoded filter on ``signals``
    # then stays above it instead of being pushed below with the whole decode inlined.
    out = F.when(F.col("layout").isNotNull(), signals).alias("signals")
    return joined.select(*frames.columns, "message_name", F.inline_outer(F.array(F.struct(out))))


def decode_long(frames: DataFrame, dbc: Dbc | None, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                salt_buckets: int = 64, strategy: str = "auto", motorola: bool = False,
                keep_payload: bool = False) -> DataFrame:
    """One row per (frame, active signal): the frame columns + message_name, signal_index,
    signal_name, raw_value, value, unit, value_description (P10, ``signals_long``).

    The payload is not repeated on every signal row unless ``keep_payload=True`` (join it
    back on ``(trace_id, ordinal)`` when needed)."""
    dbc = _require(dbc)
    if strategy in ("auto", "compiled"):
        layout = compiled_layout(dbc, motorola)
        if layout is not None:
            out = explode_signals(decode_nested_compiled(frames, layout))
            return out if keep_payload else out.drop("payload")
        if strategy == "compiled":
            raise DecodeError("dictionary too large to compile; use strategy='join'")
    prog, ids = program.build(dbc, motorola), _dictionary_ids(dbc)
    broadcast = prog.broadcast and prog.rows <= max_broadcast_rows
    keep = [c for c in frames.columns if keep_payload or c != "payload"]
    return program.decode_long(frames, prog, keep, lambda f, t, active: _join_dictionary(f, t, "inner", broadcast, salt_buckets, ids, active))


def explode_signals(decoded: DataFrame) -> DataFrame:
    """Nested → long (P10), keeping dictionary order via ``signal_index``.

    ``inline_outer`` + a null filter instead of ``inline``: for a plain generator the
    optimizer infers ``size(signals) > 0`` and pushes it below the decode projection,
    which evaluates the whole decode expression twice."""
    keep = [c for c in decoded.columns if c != "signals"]
    out = decoded.select(*keep, F.inline_outer("signals")).filter(F.col("signal_index").isNotNull())
    return out.withColumnRenamed("name", "signal_name")


def can_decode(frames: DataFrame, dbc: Dbc) -> DataFrame:
    """Frames whose id has a definition (P1): a left-semi join with the messages."""
    msgs = dbc.messages.select("can_id")
    return frames.join(F.broadcast(msgs) if checked_count(dbc.messages) <= DEFAULT_MAX_BROADCAST_ROWS else msgs,
                       "can_id", "left_semi")
