"""User hooks.

A hook is a predicate over frame fields or over the decoded message name.  The preferred
form is a Spark ``Column`` or an SQL expression string (JVM-side, pushed down where
possible); a Python function is accepted and runs as an Arrow-batched ``pandas_udf``
(vectorised, never per row through pickling).  A disabled hook accepts every row; a
result that is not true/false (null) accepts, as in the reference.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_HOOK_ARGS = ("timestamp_ns", "can_id", "channel", "dlc")


def _ship() -> None:
    """Python hooks may be defined in library modules; make them importable on workers."""
    from pyspark.sql import SparkSession

    from ..session import ship_package

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)


def _verdicts(result, n: int) -> pd.Series:
    """Only a boolean result can reject; any other value accepts."""
    if not isinstance(result, pd.Series):
        result = pd.Series(result if hasattr(result, "__len__") and not isinstance(result, str) else [result] * n)
    if pd.api.types.is_bool_dtype(result.dtype):
        return result.astype("boolean").fillna(True)
    return result.map(lambda x: x is not False).astype("boolean")


def frame_hook(fn=None, expr: str | Column | None = None, enabled: bool = True) -> Column:
    """Boolean column for a frame hook.

    ``fn(timestamp_ns, can_id, channel, dlc)`` receives pandas Series and returns a
    boolean Series; ``expr`` is a Column or SQL string over the same fields."""
    if not enabled or (fn is None and expr is None):
        return F.lit(True)
    if expr is not None:
        c = F.expr(expr) if isinstance(expr, str) else expr
        return F.when(F.typeof(c) == "boolean", F.coalesce(c.try_cast("boolean"), F.lit(True))).otherwise(F.lit(True))
    _ship()
    udf = F.pandas_udf(lambda a, b, c, d: _verdicts(fn(a, b, c, d), len(a)), T.BooleanType())
    return F.coalesce(udf(*[F.col(x) for x in FRAME_HOOK_ARGS]), F.lit(True))


def decoded_hook(fn=None, expr: str | Column | None = None, enabled: bool = True) -> Column:
    """Boolean column for a decoded hook on ``message_name``."""
    if not enabled or (fn is None and expr is None):
        return F.lit(True)
    if expr is not None:
        c = F.expr(expr) if isinstance(expr, str) else expr
        return F.when(F.typeof(c) == "boolean", F.coalesce(c.try_cast("boolean"), F.lit(True))).otherwise(F.lit(True))
    _ship()
    udf = F.pandas_udf(lambda s: _verdicts(fn(s), len(s)), T.BooleanType())
    return F.coalesce(udf(F.col("message_name")), F.lit(True))


def transform_hook(df: DataFrame, fn) -> DataFrame:
    """Row transform hook (U4): a DataFrame → DataFrame function applied lazily."""
    return df.transform(fn)
