"""Join planning for the small side of a join: broadcast only behind a checked bound.

Dictionary tables (messages, signals, labels) and per-split count tables are small, but
"small" is a property of the data, not of the code.  ``join_small`` counts the small side
(cheap: it is an aggregate or a dictionary) and broadcasts it only when the count is below
``max_rows``; beyond that the join is left to a shuffle join, where AQE's skew handling
applies.  The count is cached on the DataFrame object so repeated joins do not re-count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast bound in rows for the small side of a join (about 100 bytes a row).
DEFAULT_MAX_BROADCAST_ROWS = 200_000

_COUNT_ATTR = "_canlens_rows"


def checked_count(df: DataFrame) -> int:
    n = getattr(df, _COUNT_ATTR, None)
    if n is None:
        n = df.count()
        try:
            setattr(df, _COUNT_ATTR, n)
        except AttributeError:  # pragma: no cover - Connect DataFrames may be frozen
            pass
    return n


def mark_rows(df: DataFrame, n: int) -> DataFrame:
    """Record a known row bound (e.g. from a dictionary load) to skip a count."""
    try:
        setattr(df, _COUNT_ATTR, n)
    except AttributeError:  # pragma: no cover
        pass
    return df


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> bool:
    return checked_count(df) <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with ``small``, broadcasting ``small`` only if its count is bounded."""
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    # Spark's own estimate, by the bytes of a file, would still broadcast rows that a generator multiplies.
    return big.join(small.hint("merge"), on, how)
