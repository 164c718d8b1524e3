"""Context retrieval around matches.

Context is ordinal arithmetic on the *unfiltered* frames: the rows
``[max(0, o - before), min(n - 1, o + after)]`` of the same trace.  For many matches:

* the windows are merged into *islands*, kept as bins of ``BIN`` ordinals of a trace with one bit for each
  covered ordinal, so neighbouring and overlapping windows cost nothing twice;
* frames outside the islands go before anything is shuffled: by bounds of each trace, which the scan's
  statistics use, then by the bins, broadcast while they are few, else by a map of fixed size over
  the hashed bins (``MAP_BITS`` bits; a bit set by chance lets a frame through to the exact join);
* what is left is joined with the windows on ``(trace_id, ordinal)``, traces by number: each match has at most
  ``before + after + 1`` rows, no range join, no pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.sizing import checked_count, fits_broadcast, join_small, mark_rows
from ..sources.lines import materialize


def context_of(frames: DataFrame, ordinal: int, before: int = 0, after: int = 0, trace_id: str | None = None,
               enabled: bool = True) -> DataFrame:
    """Frames around one ordinal (C1, C2); empty if disabled or the ordinal is not in the trace."""
    if before < 0 or after < 0:
        raise QueryError("before/after must be >= 0")
    df = frames if trace_id is None else frames.filter(F.col("trace_id") == trace_id)
    if not enabled:
        return df.limit(0)
    lo, hi = max(0, ordinal - before), ordinal + after
    window = df.filter(F.col("ordinal").between(lo, hi))
    # The match itself must exist (ordinal < n): a semi join with its own row.
    anchor = df.filter(F.col("ordinal") == ordinal).select("trace_id")
    return window.join(anchor, "trace_id", "left_semi").withColumn(
        "rel_pos", F.col("ordinal") - F.lit(ordinal))


#: Ordinals of a bin: the bits of a long.
BIN = 64
#: Traces whose bounds are written into the scan's filter.
MAX_BOUNDS = 64
#: Bits of the map of hashed bins: 16 MB in pieces of 2**15 bits.
MAP_BITS, PIECE_BITS = 27, 15


def _within_bounds(m: DataFrame, before: int, after: int) -> Column:
    """Frames between the first and the last window of each trace, or of all if there are many traces."""
    bounds = m.groupBy("trace_id").agg(F.min("match_ordinal").alias("lo"), F.max("match_ordinal").alias("hi"))
    rows = bounds.limit(MAX_BOUNDS + 1).collect()
    if not rows:
        return F.lit(False)
    if len(rows) > MAX_BOUNDS:
        lo, hi = bounds.agg(F.min("lo"), F.max("hi")).first()
        return F.col("ordinal").between(max(0, lo - before), hi + after)
    inside = [F.col("trace_id").eqNullSafe(F.lit(r.trace_id)) & F.col("ordinal").between(max(0, r.lo - before), r.hi + after) for r in rows]
    return reduce(lambda a, b: a | b, inside)


def islands(windows: DataFrame) -> DataFrame:
    """(trace_id, bin, covered): the covered ordinals of each bin, as bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("ordinal", F.lit(BIN)).cast("int"))
    return windows.groupBy("trace_id", F.floor(F.col("ordinal") / BIN).alias("bin")).agg(F.bit_or(bit).alias("covered"))


def _hashed(bin_: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("trace_id"), bin_), F.lit(1 << MAP_BITS))


def _on_islands(frames: DataFrame, bins: DataFrame) -> DataFrame:
    """Frames on the islands; beyond the bound of a broadcast, also those that the map lets through."""
    own = F.floor(F.col("ordinal") / BIN)
    if fits_broadcast(bins):
        there = F.broadcast(bins.select(F.col("trace_id").alias("_trace"), F.col("bin").alias("_bin"), "covered"))
        bit = F.call_function("shiftright", F.col("covered"), F.pmod("ordinal", F.lit(BIN)).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
        return frames.join(there, (F.col("trace_id") == F.col("_trace")) & (own == F.col("_bin")) & (bit == 1), "left_semi")
    spot = bins.select(_hashed(F.col("bin")).alias("h"))
    pieces = spot.groupBy(F.shiftright("h", PIECE_BITS).alias("_piece")).agg(
        F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit((1 << PIECE_BITS) - 1).cast("bigint"))).alias("_map"))
    at = _hashed(own)
    place = at.bitwiseAND(F.lit((1 << PIECE_BITS) - 1).cast("bigint")).cast("int")
    byte = F.conv(F.hex(F.substr(F.col("_map"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
    there = F.broadcast(pieces)  # 2**(MAP_BITS - PIECE_BITS) rows at most
    return frames.join(there, (F.shiftright(at, PIECE_BITS) == F.col("_piece")) & (bit == 1), "left_semi")


def context_of_matches(frames: DataFrame, matches: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Context rows of every match (C3): ``match_ordinal``, ``rel_pos`` and the frame columns.

    ``matches`` needs ``trace_id`` and ``ordinal`` (any query result).  Windows of
    neighbouring matches may overlap; each (match, row) pair appears once."""
    if before < 0 or after < 0:
        raise QueryError("before/after must be >= 0")
    # Written once: the bounds, the islands and the join all read the matches.
    m = materialize(matches.select("trace_id", F.col("ordinal").alias("match_ordinal")).distinct(), "matches")
    near = frames.filter(_within_bounds(m, before, after))
    w = m.withColumn(
        "ordinal",
        F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("match_ordinal") - before),
                             F.col("match_ordinal") + after)))
    if not fits_broadcast(w):
        # Many matches: only frames on islands are shuffled, on a key that is unique among frames.
        near = _on_islands(near, materialize(islands(w.select("trace_id", "ordinal")), "islands"))
        out = _by_number(near, w, m)
    else:
        out = join_small(near, w, ["trace_id", "ordinal"])
    return out.withColumn("rel_pos", F.col("ordinal") - F.col("match_ordinal"))


def _by_number(near: DataFrame, windows: DataFrame, matches: DataFrame) -> DataFrame:
    """``near`` joined with ``windows``; while there are few traces, by a number for each instead of its name,
    which would be the most of every row that is shuffled and sorted."""
    traces = materialize(matches.select("trace_id").distinct().withColumn("_number", F.monotonically_increasing_id()), "traces")
    if not fits_broadcast(traces):
        return join_small(near, windows, ["trace_id", "ordinal"])
    names = F.broadcast(traces)
    short, wide = (df.join(names, "trace_id").drop("trace_id") for df in (windows, near))
    found = join_small(wide, mark_rows(short, checked_count(windows)), ["_number", "ordinal"]).join(names, "_number")
    return found.select("trace_id", "ordinal", *[c for c in near.columns if c not in ("trace_id", "ordinal")], "match_ordinal")
