"""The query plan of the reference, as chained DataFrame operations.

    ordinal range → raw filter (+ frame hook) → decode → decoded filter (+ decoded hook)
    → optional first-N in source order

Every step is a lazy transformation; Catalyst pushes the ordinal/raw predicates into the
Parquet scan (row-group statistics on ``ordinal``/``timestamp_ns``/``can_id``) and below
the dictionary join.  Decoding is added only when a decoded field or output is asked for.
Ordering is applied only where it is the feature (first match, max matches, ordered
output); ``orderBy(...).limit(n)`` plans as a top-k, not a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DecodeError, QueryError
from ..operators.compiled import compiled_layout, decode_nested_compiled
from ..operators.decode import decode_nested
from ..operators.filters import (
    compile_decoded,
    compile_raw,
    ordinal_range,
    same_signal,
    uses_decoded_fields,
    with_single_id,
)
from ..sources.dbc import Dbc
from ..sources.lines import materialize
from .sizing import join_small

ORDER = ["trace_id", "ordinal"]


def _hook_column(hook) -> Column | None:
    if hook is None:
        return None
    if isinstance(hook, Column):
        return hook
    if isinstance(hook, str):
        return F.expr(hook)
    if callable(hook):
        return hook()
    raise QueryError(f"unsupported hook {hook!r}")


def run_query(frames: DataFrame, raw_filter=None, decoded_filter=None, dbc: Dbc | None = None,
              decode: bool = False, ordinal_start: int | None = None, ordinal_end: int | None = None,
              can_id: int | None = None, first_only: bool = False, max_matches: int | None = None,
              keep_undecoded: bool = False, frame_hook=None, decoded_hook=None, ordered: bool = False,
              double_compat: bool = False, compat_single_id: bool = False,
              same_signal_filter: tuple | None = None, strategy: str = "auto") -> DataFrame:
    """Run one query over ``frames`` and return the matching rows.

    ``first_only`` / ``max_matches`` return the first rows in source order (per trace id and
    ordinal); ``max_matches=0`` returns nothing (the reference returns one row, Q14).
    ``same_signal_filter=(name, op, value)`` keeps frames where one signal satisfies both
    (G5).  ``strategy`` picks the decode path (``auto``/``compiled``/``join``)."""
    df = frames
    if ordinal_start is not None or ordinal_end is not None:
        df = df.filter(ordinal_range(ordinal_start, ordinal_end))
    df = df.filter(compile_raw(with_single_id(raw_filter, can_id, compat_single_id), double_compat=double_compat))
    hook = _hook_column(frame_hook)
    if hook is not None:
        df = df.filter(hook)
    d_hook = _hook_column(decoded_hook)
    needs_decode = (decode or uses_decoded_fields(decoded_filter) or d_hook is not None
                    or same_signal_filter is not None)
    if needs_decode:
        if dbc is None:
            raise DecodeError("decoding needs a message dictionary")
        layout = compiled_layout(dbc) if strategy in ("auto", "compiled") else None
        if layout is not None:
            # Small dictionary: the decoded filter is compiled too and runs before decoding.
            filtered = decoded_filter is not None or same_signal_filter is not None
            df = decode_nested_compiled(df, layout, keep_undecoded=keep_undecoded and not filtered,
                                        decoded_filter=decoded_filter, same_signal_args=same_signal_filter)
        else:
            df = decode_nested(df, dbc, keep_undecoded=keep_undecoded, strategy="join")
            if decoded_filter is not None:
                df = df.filter(compile_decoded(decoded_filter))
            if same_signal_filter is not None:
                df = df.filter(same_signal(*same_signal_filter))
        if d_hook is not None:
            df = df.filter(d_hook)
    if first_only:
        return df.orderBy(*ORDER).limit(1)
    if max_matches is not None:
        return df.orderBy(*ORDER).limit(max(0, int(max_matches)))
    return df.orderBy(*ORDER) if ordered else df


def summary_counts(frames: DataFrame, matches_filter: Column | None = None, ordinal_start: int | None = None,
                   ordinal_end: int | None = None) -> DataFrame:
    """Scanned and matched counts per trace in one pass (A1)."""
    df = frames
    if ordinal_start is not None or ordinal_end is not None:
        df = df.filter(ordinal_range(ordinal_start, ordinal_end))
    m = matches_filter if matches_filter is not None else F.lit(True)
    return df.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(m).alias("matched"))


#: Ordinals of a range in which matches are counted first: 2**16.
RANGE_BITS = 16


def early_stop_counts(frames: DataFrame, matches_filter: Column, max_matches: int, ordinal_start: int | None = None,
                      ordinal_end: int | None = None) -> DataFrame:
    """Scanned and matched counts per trace of a scan that ends at match ``max_matches`` (A1 with L2/L3).

    With fewer matches a trace is scanned to its end; with ``max_matches`` 0 or less nothing is
    scanned.  ``frames`` holds whole traces: as ordinals are dense, the frames up to the stopping
    one follow from its ordinal.  Selection has two levels, so no task gets a trace's matches: frames and
    matches are counted by trace and range of 2**``RANGE_BITS`` ordinals, a running sum over the ranges finds
    the one that holds match number ``max_matches``, and only that range's matches are ranked."""
    df = frames
    if ordinal_start is not None or ordinal_end is not None:
        df = df.filter(ordinal_range(ordinal_start, ordinal_end))
    n = max(0, int(max_matches))
    df = df.withColumn("_range", F.shiftright("ordinal", RANGE_BITS))
    counted = df.groupBy("trace_id", "_range").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ordinal").alias("first"), F.count_if(matches_filter).alias("hits"))
    upto = F.sum("hits").over(Window.partitionBy("trace_id").orderBy("_range"))
    ranges = materialize(counted.withColumn("upto", upto), "match-ranges")
    whole = ranges.groupBy("trace_id").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.sum("hits").alias("hits"))
    if not n:
        zero = F.lit(0).cast("bigint")
        return whole.select("trace_id", zero.alias("scanned"), zero.alias("matched"))
    before = F.col("upto") - F.col("hits")
    stop = ranges.filter((F.col("upto") >= n) & (before < n)).select("trace_id", "_range", (F.lit(n) - before).alias("left"))
    inside = join_small(df.filter(matches_filter).select("trace_id", "_range", "ordinal"), stop, ["trace_id", "_range"])
    rank = F.row_number().over(Window.partitionBy("trace_id", "_range").orderBy("ordinal"))
    last = inside.withColumn("rank", rank).filter(F.col("rank") == F.col("left")).select("trace_id", F.col("ordinal").alias("last"))
    return whole.join(last, "trace_id", "left").select(
        "trace_id", F.coalesce(F.col("last") - F.col("first") + 1, F.col("rows")).alias("scanned"),
        F.least("hits", F.lit(n)).cast("bigint").alias("matched"))
