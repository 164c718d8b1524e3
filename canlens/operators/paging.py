"""Paging and time windows: bound arithmetic on the driver, then a
pushed-down range filter."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import compile_raw, time_range

DEFAULT_PAGE_SIZE = 2000
_U64_MAX = (1 << 64) - 1


def shift_ordinal_window(start: int, size: int = DEFAULT_PAGE_SIZE, pages: int = 0) -> tuple[int, int]:
    """Move an ordinal window of ``size`` by ``pages`` windows, clamped at 0 (L4)."""
    size = max(1, int(size))
    new_start = max(0, int(start) + int(pages) * size)
    return new_start, new_start + size - 1


def page(frames: DataFrame, start: int, size: int = DEFAULT_PAGE_SIZE, pages: int = 0) -> DataFrame:
    lo, hi = shift_ordinal_window(start, size, pages)
    return frames.filter(F.col("ordinal").between(lo, hi))


def time_bounds(frames: DataFrame) -> tuple[int, int] | None:
    """(min, max) timestamp of ``frames``: one tiny aggregate row to the driver."""
    r = frames.agg(F.min("timestamp_ns").alias("lo"), F.max("timestamp_ns").alias("hi")).collect()[0]
    return None if r["lo"] is None else (int(r["lo"]), int(r["hi"]))


def _around(centre: int, half: int, bounds: tuple[int, int] | None) -> tuple[int, int]:
    """``half`` on both sides of ``centre``, clipped (not shifted) to ``bounds``; a window that
    would begin at or below 0 begins at the lower bound."""
    low, high = bounds if bounds is not None else (0, _U64_MAX)
    start = max(low, centre - half) if centre > half else low
    return min(high, start), min(high, max(start, centre + half))


def zoom(lo: int, hi: int, factor: float, bounds: tuple[int, int] | None = None) -> tuple[int, int]:
    """Scale a window around its centre (0.5 halves, 2 doubles), in whole ns rounded down, at
    least 1 ns to each side, clipped to ``bounds`` (L5)."""
    span = max(0, hi - lo)
    return _around(lo + span // 2, max(1, int(span * Fraction(factor) / 2)), bounds)


def pan(lo: int, hi: int, fraction: float) -> tuple[int, int]:
    """Move a window by a fraction of its width, clamped at 0 and u64 max."""
    d = int(round((hi - lo) * fraction))
    if lo + d < 0:
        d = -lo
    return lo + d, min(_U64_MAX, hi + d)


def centre_on(lo: int, hi: int, ts: int, bounds: tuple[int, int] | None = None) -> tuple[int, int]:
    """Centre a window of the same width on ``ts``, clipped to ``bounds`` if given."""
    return _around(ts, max(1, max(0, hi - lo) // 2), bounds)


def time_window(frames: DataFrame, lo: int, hi: int) -> DataFrame:
    """Frames from ``lo`` to ``hi`` ns, any u64 values."""
    return frames.filter(compile_raw(time_range(lo, hi)))
