"""Filter trees compiled to one Spark ``Column``.

A tree is made of ``Pred(field, op, value)`` leaves and ``And``/``Or``/``Not`` nodes.  It
is compiled once on the driver into a boolean ``Column``; Spark then pushes the raw part
into the Parquet scan and evaluates everything in generated code.

Semantics kept from the reference:

* numeric fields compare with ``eq ne lt le gt ge``; ``contains`` on a number is false;
  a text or ``None`` literal on a numeric field is false (``ne`` included); booleans are
  1/0;
* text fields (``message_name``, ``signal_name``) compare case-insensitively with
  ``eq ne contains``; ordering operators on text are false;
* ``signal_name`` / ``signal_value`` are true when *any* active signal of the frame
  satisfies them (not tied to one signal; see ``same_signal`` for that);
* ``Not`` negates its first child only and is true without children; an empty ``And`` /
  ``Or`` (or ``None``) matches everything;
* a decoded field inside a raw filter, or a raw field inside a decoded filter, is
  constant true (``strict_fields=True`` raises instead).

Numbers: by default an integer literal compares exactly as BIGINT (so the predicate
reaches Parquet statistics); a float literal compares the field as DOUBLE.
``double_compat=True`` compares every numeric pair as DOUBLE like the reference does
(timestamps beyond 2^53 ns then lose precision, as there).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

# Field names, operators, frame kind words.
RAW_FIELDS = ("timestamp_ns", "can_id", "channel", "frame_type")
DECODED_FIELDS = ("message_name", "signal_name", "signal_value")
OPERATORS = ("eq", "ne", "lt", "le", "gt", "ge", "contains")
_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1
FRAME_TYPE_WORDS = {"can": 0, "can20": 0, "2.0": 0, "fd": 1, "canfd": 1, "can fd": 1}


@dataclass(frozen=True)
class Pred:
    field: str
    op: str
    value: object = None

    def __post_init__(self):
        if self.field not in RAW_FIELDS + DECODED_FIELDS:
            raise QueryError(f"unknown filter field {self.field!r}")
        if self.op not in OPERATORS:
            raise QueryError(f"unknown filter operator {self.op!r}")


@dataclass(frozen=True)
class And:
    children: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Or:
    children: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Not:
    children: tuple = field(default_factory=tuple)


def all_of(*children) -> And:
    return And(tuple(children))


def any_of(*children) -> Or:
    return Or(tuple(children))


def negate(child=None) -> Not:
    return Not(() if child is None else (child,))


def uses_decoded_fields(expr) -> bool:
    if expr is None:
        return False
    if isinstance(expr, Pred):
        return expr.field in DECODED_FIELDS
    return any(uses_decoded_fields(c) for c in expr.children)


def _is_empty(expr) -> bool:
    return expr is None or (not isinstance(expr, Pred) and len(expr.children) == 0)


def _numeric_literal(value):
    """(kind, value) with kind 'int', 'float' or None (not numeric)."""
    if isinstance(value, bool):
        return "int", int(value)
    if isinstance(value, int):
        return "int", value
    if isinstance(value, float):
        return "float", value
    return None, None


def _cmp(left: Column, op: str, right: Column, nan_guard: bool = False) -> Column:
    if op == "contains":
        return F.lit(False)
    ops = {
        "eq": lambda a, b: a == b,
        "ne": lambda a, b: a != b,
        "lt": lambda a, b: a < b,
        "le": lambda a, b: a <= b,
        "gt": lambda a, b: a > b,
        "ge": lambda a, b: a >= b,
    }
    out = ops[op](left, right)
    if nan_guard:
        # IEEE rules: every comparison with NaN is false except "ne".
        out = (F.isnan(left) | out) if op == "ne" else (~F.isnan(left) & out)
    return out


def _raw_leaf(p: Pred, double_compat: bool) -> Column:
    value = p.value
    if p.field == "frame_type" and isinstance(value, str) and value.strip().lower() in FRAME_TYPE_WORDS:
        value = FRAME_TYPE_WORDS[value.strip().lower()]
    kind, v = _numeric_literal(value)
    if kind is None:
        return F.lit(False)
    col = F.col(p.field)
    if double_compat or kind == "float":
        if kind == "float" and math.isnan(v):
            return F.lit(p.op == "ne")
        return _cmp(col.cast("double"), p.op, F.lit(float(v)))
    if not _LONG_MIN <= v <= _LONG_MAX:  # beyond every stored value, whatever the row
        return F.lit(p.op == "ne" or p.op in (("lt", "le") if v > 0 else ("gt", "ge")))
    return _cmp(col, p.op, F.lit(v).cast("bigint"))


def compile_raw(expr, double_compat: bool = False, strict_fields: bool = False) -> Column:
    """Compile a filter tree over the ``frames`` columns."""
    if _is_empty(expr):
        return F.lit(True)
    if isinstance(expr, Pred):
        if expr.field in DECODED_FIELDS:
            if strict_fields:
                raise QueryError(f"decoded field {expr.field!r} in a raw filter")
            return F.lit(True)
        return _raw_leaf(expr, double_compat)
    return _combine(expr, lambda e: compile_raw(e, double_compat, strict_fields))


def _combine(expr, rec) -> Column:
    if isinstance(expr, Not):
        return ~rec(expr.children[0])
    parts = [rec(c) for c in expr.children]
    if isinstance(expr, And):
        return reduce(lambda a, b: a & b, parts)
    return reduce(lambda a, b: a | b, parts)


def _text_cmp(left: Column, op: str, value: str) -> Column:
    lv = F.lower(left)
    rv = F.lit(value.lower())
    if op == "eq":
        return lv == rv
    if op == "ne":
        return lv != rv
    if op == "contains":
        return F.instr(lv, value.lower()) > 0 if value else F.lit(True)
    return F.lit(False)


def signal_leaf(s: Column, p: Pred) -> Column:
    """Predicate on one decoded signal struct (fields ``name`` and ``value``)."""
    if p.field == "signal_name":
        return _text_cmp(s["name"], p.op, p.value) if isinstance(p.value, str) else F.lit(False)
    kind, v = _numeric_literal(p.value)
    if kind is None:
        return F.lit(False)
    if isinstance(v, float) and math.isnan(v):
        return F.lit(p.op == "ne")
    return _cmp(s["value"], p.op, F.lit(float(v)), nan_guard=True)


def _decoded_leaf(p: Pred, signals: Column, message: Column) -> Column:
    if p.field == "message_name":
        if not isinstance(p.value, str):
            return F.lit(False)
        return F.coalesce(_text_cmp(message, p.op, p.value), F.lit(False))
    return F.coalesce(F.exists(signals, lambda s: signal_leaf(s, p)), F.lit(False))


def compile_decoded(expr, signals: str | Column = "signals", message: str | Column = "message_name",
                    strict_fields: bool = False) -> Column:
    """Compile a filter tree over decoded frames (G1-G4): ``signals`` is the array of
    active signals, ``message`` the message name."""
    sig = F.col(signals) if isinstance(signals, str) else signals
    msg = F.col(message) if isinstance(message, str) else message
    if _is_empty(expr):
        return F.lit(True)
    if isinstance(expr, Pred):
        if expr.field in RAW_FIELDS:
            if strict_fields:
                raise QueryError(f"raw field {expr.field!r} in a decoded filter")
            return F.lit(True)
        return _decoded_leaf(expr, sig, msg)
    return _combine(expr, lambda e: compile_decoded(e, sig, msg, strict_fields))


def same_signal(name: str, op: str, value, signals: str | Column = "signals") -> Column:
    """Name and value tested on the *same* signal (G5, an addition to the reference)."""
    sig = F.col(signals) if isinstance(signals, str) else signals
    pn = Pred("signal_name", "eq", name)
    pv = Pred("signal_value", op, value)
    return F.coalesce(F.exists(sig, lambda s: signal_leaf(s, pn) & signal_leaf(s, pv)), F.lit(False))


# ----------------------------------------------------------------------------- builders


def from_clauses(and_clauses=(), or_clauses=(), not_clauses=()):
    """AND of each and-clause, one OR of all or-clauses, and NOT of each not-clause.

    Clauses are ``(field, op, value)`` tuples or ``Pred``; one child collapses to itself;
    no clause gives ``None`` (match all)."""
    mk = lambda c: c if isinstance(c, Pred) else Pred(*c)
    children = [mk(c) for c in and_clauses]
    if or_clauses:
        children.append(Or(tuple(mk(c) for c in or_clauses)))
    children += [Not((mk(c),)) for c in not_clauses]
    if not children:
        return None
    return children[0] if len(children) == 1 else And(tuple(children))


def _parse_rule_value(field_name: str, text: str):
    t = text.strip()
    if not t:
        return None
    if field_name in ("timestamp_ns", "can_id", "channel"):
        try:
            return int(t, 16) if t.lower().startswith("0x") else int(t)
        except ValueError:
            return None
    if field_name == "frame_type":
        return FRAME_TYPE_WORDS.get(t.lower())
    if field_name == "signal_value":
        try:
            return float(t)
        except ValueError:
            return None
    return t


def _expand_rule(mode: str, value_text: str) -> list[tuple[str, str]]:
    """(mode, item text) pairs of a rule value.

    Items separated by ``&`` keep the rule's mode, items separated by ``|`` or ``,`` become
    "any" (an exclude rule stays one); in a list, a leading ``!`` or ``-`` excludes the item.
    Without separators, or with both kinds, the text is one item as it stands."""
    text = value_text.strip()
    separators = set(re.findall("[&|,]", text))
    mixed = "&" in separators and len(separators) > 1
    if not separators or mixed:
        return [(mode, text)] if text else []
    if "&" not in separators and mode == "must":
        mode = "any"
    items = (re.fullmatch(r"\s*([!-]?)\s*(.*?)\s*", part, re.DOTALL).groups() for part in re.split("[&|,]", text))
    return [("exclude" if sign else mode, item) for sign, item in items if item]


@dataclass(frozen=True)
class Rule:
    """One rule row: ``field op value`` with mode ``must`` / ``any`` / ``exclude``."""

    field: str
    op: str
    value: str
    mode: str = "must"
    enabled: bool = True


def from_rules(rules) -> object:
    """Rule rows → tree (F15): must-clauses, one OR of any-clauses, NOT of exclude-clauses."""
    must, anys, excl = [], [], []
    for r in rules:
        if not r.enabled:
            continue
        for mode, text in _expand_rule(r.mode, r.value):
            v = _parse_rule_value(r.field, text)
            if v is None:
                continue
            p = Pred(r.field, r.op, v)
            {"must": must, "any": anys, "exclude": excl}[mode].append(p if mode != "exclude" else Not((p,)))
    children = list(must)
    if anys:
        children.append(Or(tuple(anys)))
    children += excl
    if not children:
        return None
    return children[0] if len(children) == 1 else And(tuple(children))


# ----------------------------------------------------------------------------- range helpers


def ordinal_range(start: int | None = None, end: int | None = None) -> Column:
    """Inclusive ordinal window (F11); a reversed range is an error (Q20)."""
    if start is not None and end is not None and end < start:
        raise QueryError(f"ordinal range end {end} < start {start}")
    c = F.lit(True)
    if start is not None:
        c = c & (F.col("ordinal") >= F.lit(start))
    if end is not None:
        c = c & (F.col("ordinal") <= F.lit(end))
    return c


def time_range(start_ns: int | None = None, end_ns: int | None = None):
    """Inclusive time bounds as ge/le clauses (F12); returns a tree or ``None``."""
    parts = []
    if start_ns is not None:
        parts.append(Pred("timestamp_ns", "ge", int(start_ns)))
    if end_ns is not None:
        parts.append(Pred("timestamp_ns", "le", int(end_ns)))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def with_single_id(expr, can_id: int | None, compat: bool = False):
    """Single-id shortcut (F13): ANDed with the filter; ``compat=True`` ignores the id
    when a filter is present, as the reference does (Q15)."""
    if can_id is None:
        return expr
    leaf = Pred("can_id", "eq", int(can_id))
    if _is_empty(expr):
        return leaf
    return expr if compat else And((expr, leaf))


def hide_ids(frames, ids):
    """Rows whose id is not hidden (F16).  ``ids``: a list (``NOT IN``, pushed to the scan)
    or a DataFrame with a ``can_id`` column (left-anti join; broadcast behind a checked
    size, else a shuffle join)."""
    from ..plans.sizing import join_small

    if isinstance(ids, (list, tuple, set, frozenset)):
        return frames.filter(~F.col("can_id").isin(list(ids))) if ids else frames
    return join_small(frames, ids.select("can_id").distinct(), "can_id", "left_anti")
