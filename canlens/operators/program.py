"""Decode with a dictionary of any size: one generic program over typed parameters.

The dictionary becomes *parameters*: for each signal the number of the 64-bit payload word it starts in, a
shift, a mask, a sign shift, scale and offset.  The expressions that read them are the same for every
signal, so their generated code doesn't grow with the dictionary, holds no lambda and no struct of a
layout, and stays in whole-stage codegen:

* the payload becomes an array of 64-bit words once per frame, only as many as the dictionary reaches
  (big-endian words, little-endian words, each followed by zeros, so that a signal's two words are
  always there);
* ``decode_long``: frames meet the table of signals (one row each) by broadcast hash join on ``can_id``,
  which gives the (frame, signal) rows directly; the multiplexer test is part of the join condition;
* ``decode_nested``: frames meet the table of messages, whose parameters are arrays.  Signal k of a message
  is slot k: the same expression on element k of each array, for as many slots as the largest message has.

Parts that a dictionary has no use for (multiplexing, floats, big-endian signals, labels, signals wider
than 64 bits) are left out.  The tables are broadcast while they are within ``MAX_ROWS`` and ``MAX_BYTES``,
measured on the tables themselves; beyond that the caller joins by shuffle (``decode.py``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import float32_from_bits, float64_from_bits
from .compiled import be_word

#: A payload has 64 bytes at most.
MAX_WORDS = 8
#: Bounds of a broadcast dictionary.
MAX_ROWS, MAX_BYTES = 200_000, 32 << 20
#: Slots of a message that are written out; messages with more signals are decoded element by element.
MAX_SLOTS = 64
_SIGNAL = "struct<signal_index:int,name:string,raw_value:bigint,value:double,unit:string,value_description:string>"
#: Typed parameters of a signal.
LONGS = ["mask", "mux"]
INTS = ["signal_index", "q", "r", "n", "start", "sx", "kind"]
DOUBLES = ["scale", "offset"]
TEXTS = ["signal_name", "unit"]
#: Prefix of the dictionary's columns beside those of the frames.
OWN = "_d_"
UNSIGNED, SIGNED, FLOAT32, FLOAT64, WIDE = range(5)


@dataclass
class Program:
    signals: DataFrame  # a row per signal: can_id, message_name, parameters, labels, sel_*
    messages: DataFrame  # a row per message: can_id, message_name, sel_*, arrays of the parameters
    words: int
    slots: int
    rows: int
    size: int
    big_endian: bool
    signed: bool
    floats: bool
    wide: bool
    muxed: bool
    labelled: bool
    #: Expressions of the nested form; building them takes thousands of calls, so they are kept.
    slots_built: dict[str, Column] = field(default_factory=dict)

    @property
    def broadcast(self) -> bool:
        return self.rows <= MAX_ROWS and self.size <= MAX_BYTES


def _long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def _shift(kind: str, a: Column, n: Column) -> Column:
    return F.call_function(kind, a, n)


def _placed(layouts: DataFrame, words: int, motorola: bool) -> DataFrame:
    """Layouts with the parameters in place of start, length and order; q counts from 0 in ``payload_array``."""
    le, n = F.col("little_endian"), F.col("bit_length")
    start = F.col("start_bit")
    if motorola:
        start = F.when(le, start).otherwise(F.floor(start / 8).cast("int") * 8 + 7 - start % 8)
    start = F.coalesce(start, F.lit(-1))
    good = n.between(0, 64) & (start >= 0)
    word = F.least(_shift("shiftright", start, F.lit(6)), F.lit(words))
    kind = (F.when(~F.coalesce(good, F.lit(False)), F.lit(WIDE)).when((F.col("value_type") == "float32") & (n == 32), F.lit(FLOAT32))
            .when((F.col("value_type") == "float64") & (n == 64), F.lit(FLOAT64)).when(F.col("is_signed"), F.lit(SIGNED)).otherwise(F.lit(UNSIGNED)))
    return layouts.withColumns({
        "kind": kind, "start": start,
        "q": F.when(le, word + (words + 2)).otherwise(word),
        "r": start.bitwiseAND(F.lit(63)), "n": n,
        "mask": F.when(n <= 0, _long(0)).otherwise(_shift("shiftrightunsigned", _long(-1), 64 - F.least(n, F.lit(64)))),
        "sx": F.when((n > 0) & (n < 64), 64 - n).otherwise(F.lit(0)),
        "mux": F.col("multiplex_value").cast("bigint"),
    })


def build(dbc, motorola: bool = False) -> Program:
    """The program of a dictionary, built once and kept on it."""
    kept = dbc.__dict__.setdefault("_programs", {})
    if motorola in kept:
        return kept[motorola]
    from .decode import signal_layouts  # local import: decode imports this module

    layouts = signal_layouts(dbc)
    text = F.octet_length("signal_name") + F.octet_length("message_name") + F.coalesce(F.octet_length("unit"), F.lit(0))
    labels = F.coalesce(F.aggregate(F.map_values("labels"), F.lit(0), lambda s, x: s + F.octet_length(x) + 24), F.lit(0))
    per_message = layouts.groupBy("can_id").agg(
        F.count(F.lit(1)).alias("signals"), F.sum(text + labels + 120).alias("size"),
        F.max(F.when(F.col("bit_length").between(0, 64), F.col("start_bit") + F.col("bit_length"))).alias("reach"),
        F.max(~F.col("little_endian")).alias("big_endian"), F.max(F.col("is_signed")).alias("signed"),
        F.max(F.col("value_type").isin("float32", "float64")).alias("floats"), F.max((F.col("bit_length") > 64) | (F.col("start_bit") < 0)).alias("wide"),
        F.max(F.col("multiplex_value").isNotNull()).alias("muxed"), F.max(F.col("labels").isNotNull()).alias("labelled"))
    top = per_message.agg(*[F.max(c).alias(c) for c in per_message.columns if c not in ("can_id", "size")], F.sum("signals").alias("rows"), F.sum("size").alias("size")).first()
    words = min(MAX_WORDS, max(1, -(-int(top["reach"] or 1) // 64)))
    # the selector's parameters stand beside each signal's
    own = _placed(layouts, words, motorola)
    selector = own.where(F.col("is_multiplexer")).groupBy("can_id").agg(F.min_by(F.struct("q", "r", "n", "start", "mask", "kind"), F.col("signal_index")).alias("s"))
    selector = selector.select("can_id", *[F.col(f"s.{c}").alias(f"sel_{c}") for c in ("q", "r", "n", "start", "mask", "kind")])
    columns = [*INTS, *LONGS, *DOUBLES, *TEXTS]
    sel = [c for c in selector.columns if c != "can_id"]
    signals = own.join(selector, "can_id", "left").select("can_id", *[F.col(c).alias(f"{OWN}{c}") for c in ("message_name", *columns, "labels", *sel)])
    entry = F.struct(*[F.col(f"{OWN}{c}").alias(c) for c in (*columns, "labels")])
    arrays = signals.groupBy("can_id").agg(F.array_sort(F.collect_list(entry), _by_index).alias("p"))
    messages = dbc.messages.select("can_id", F.col("message_name").alias(f"{OWN}message_name")).join(arrays, "can_id", "left").join(selector, "can_id", "left")
    messages = messages.select("can_id", f"{OWN}message_name", F.coalesce(F.array_size("p"), F.lit(0)).alias(f"{OWN}signals"),
                               *[F.col(c).alias(f"{OWN}{c}") for c in sel], *[F.col(f"p.{c}").alias(f"{OWN}{c}") for c in (*columns, "labels")])
    flags = {c: bool(top[c]) for c in ("big_endian", "signed", "floats", "wide", "muxed", "labelled")}
    flags["signed"] |= flags["floats"]
    made = Program(dbc.keep(signals), dbc.keep(messages), words, int(top["signals"] or 0), int(top["rows"] or 0), int(top["size"] or 0), **flags)
    kept[motorola] = made
    return made


def _by_index(a: Column, b: Column) -> Column:
    return F.when(a["signal_index"] < b["signal_index"], -1).when(a["signal_index"] > b["signal_index"], 1).otherwise(0)


def _byteswap(w: Column) -> Column:
    """Bytes in reverse, by swapping halves three times."""
    for bits, low in ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        w = F.shiftrightunsigned(w, bits).bitwiseAND(_long(low)).bitwiseOR(F.shiftleft(w.bitwiseAND(_long(low)), bits))
    return w


def _opaque(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once per row and never inlined into their uses.

    A projection computes them, in generated code that splits into methods however large it is; a one-row
    generator only hands them on.  Neither projections nor filters above are merged with what is below it."""
    df = df.withColumns({f"_own{k}": c for k, c in columns.items()})
    handed = F.inline_outer(F.array(F.struct(*[F.col(f"_own{k}").alias(k) for k in columns])))
    return df.select(*[c for c in df.columns if c not in {f"_own{k}" for k in columns}], handed)


def with_words(frames: DataFrame, words: int) -> DataFrame:
    """``_w``: big-endian words, two zeros, little-endian words, two zeros."""
    n = F.length("payload")
    df = _opaque(frames, **{f"_b{q}": F.when(n > 8 * q, be_word(F.col("payload"), q)).otherwise(_long(0)) for q in range(words)})
    be = [F.col(f"_b{q}") for q in range(words)]
    zeros = [_long(0), _long(0)]
    df = _opaque(df, _w=F.array(*be, *zeros, *[_byteswap(b) for b in be], *zeros))
    return df.drop(*[f"_b{q}" for q in range(words)])


def _raw(p: Callable[[str], Column], prog: Program) -> Column:
    """Raw unsigned value by the parameters ``p(name)``."""
    lo, hi = F.get(F.col("_w"), p("q")), F.get(F.col("_w"), p("q") + 1)
    # the upper word moves in two steps, so that a shift of 64 gives zero
    value = _shift("shiftrightunsigned", lo, p("r")).bitwiseOR(_shift("shiftleft", F.shiftleft(hi, 1), 63 - p("r"))).bitwiseAND(p("mask"))
    if prog.big_endian:
        left = _shift("shiftleft", lo, p("r")).bitwiseOR(_shift("shiftrightunsigned", F.shiftrightunsigned(hi, 1), 63 - p("r")))
        there = F.least(p("n"), F.length("payload") * 8 - p("start"))  # a value cut short keeps the bits there are
        value = F.when(p("q") >= prog.words + 2, value).when(there <= 0, _long(0)).otherwise(_shift("shiftrightunsigned", left, 64 - there))
    return F.when(p("kind") != WIDE, value) if prog.wide else value


def _value(raw: Column, p: Callable[[str], Column], prog: Program) -> Column:
    unsigned = F.when(raw < 0, (raw.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("double")).otherwise(raw.cast("double"))
    number = unsigned
    if prog.signed:
        number = F.when(p("kind") == SIGNED, _shift("shiftright", _shift("shiftleft", raw, p("sx")), p("sx")).cast("double")).otherwise(unsigned)
    scaled = number * p("scale") + p("offset")
    if prog.floats:
        scaled = F.when(p("kind") == FLOAT32, float32_from_bits(raw)).when(p("kind") == FLOAT64, float64_from_bits(raw)).otherwise(scaled)
    return scaled


def _of(c: str) -> Column:
    return F.col(f"{OWN}{c}")


def _selector(c: str) -> Column:
    return _of(f"sel_{c}")


def decode_long(frames: DataFrame, prog: Program, keep: list[str], join: Callable[[DataFrame, DataFrame, Column], DataFrame]) -> DataFrame:
    """One row per frame and active signal."""
    # a selector without a value selects nothing
    active = _of("mux").isNull() | F.coalesce(_raw(_selector, prog) == _of("mux"), F.lit(False)) if prog.muxed else F.lit(True)
    joined = join(with_words(frames, prog.words), prog.signals, active)
    step = joined.withColumn("raw_value", _raw(_of, prog))
    label = F.try_element_at(_of("labels"), F.col("raw_value")) if prog.labelled else F.lit(None).cast("string")
    return step.select(*keep, *[_of(c).alias(c) for c in ("message_name", "signal_index", "signal_name")], "raw_value", _value(F.col("raw_value"), _of, prog).alias("value"),
                       _of("unit").alias("unit"), label.alias("value_description"))


def _slots(prog: Program) -> dict[str, Column]:
    """The raw values of all slots, the selector's raw value, and the active signals made of them."""
    if prog.slots_built:
        return prog.slots_built

    def slot(k: int) -> Callable[[str], Column]:
        return lambda c: F.get(_of(c), F.lit(k))

    inside = [_of("signals") > k for k in range(prog.slots)]
    raws = F.array(*[F.when(inside[k], _raw(slot(k), prog)) for k in range(prog.slots)]).cast("array<bigint>")
    empty = F.array().cast(f"array<{_SIGNAL}>")
    found = []
    for k in range(prog.slots):
        p, raw = slot(k), F.get(F.col("_raws"), F.lit(k))
        label = F.try_element_at(p("labels"), raw) if prog.labelled else F.lit(None).cast("string")
        one = F.array(F.struct(p("signal_index").alias("signal_index"), p("signal_name").alias("name"), raw.alias("raw_value"), _value(raw, p, prog).alias("value"),
                               p("unit").alias("unit"), label.alias("value_description")))
        active = inside[k] & (p("mux").isNull() | F.coalesce(F.col("_sel") == p("mux"), F.lit(False))) if prog.muxed else inside[k]
        found.append(F.when(active, one).otherwise(empty))
    signals = F.when(_of("message_name").isNotNull(), F.flatten(F.array(*found)) if found else empty)
    prog.slots_built |= {"raws": raws, "sel": _raw(_selector, prog) if prog.muxed else _long(0), "signals": signals}
    return prog.slots_built


def decode_nested(frames: DataFrame, prog: Program, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The frame columns with ``message_name`` and ``signals``, the active signals in dictionary order."""
    built = _slots(prog)
    df = _opaque(join(with_words(frames, prog.words), prog.messages), _raws=built["raws"], _sel=built["sel"])
    df = df.select(*frames.columns, _of("message_name").alias("message_name"), built["signals"].alias("_signals"))
    # a decoded filter stays above the generator, so it doesn't pull the decode into its condition
    return _opaque(df, signals=F.col("_signals")).drop("_signals")
