"""Interactive refinement over a kept scan.

A session keeps one base table (the scan, optionally decoded, written once to shared storage) and the
current result.  Filtering the full set again or refining the current matches are lazy
filters on that table: Catalyst merges stacked filters and pushes what it can into the scan, nothing is
re-read from the source files, and neither executor memory nor a lost executor bounds a session.

The table has an owner, the application that wrote it, named in a file beside it.  The owner's ``close``
removes the table; sessions that ``open_session`` made on the table of another application only read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..session import delete_shared, scratch_path, write_shared_bytes
from ..sources.dbc import Dbc
from .decode import decode_nested
from .filters import compile_decoded, compile_raw


def row_test(rows: DataFrame, raw_filter=None, decoded_filter=None, ordinal_start=None, ordinal_end=None):
    """Session row test (N5): ordinal range (ignored when end < start, as in the
    reference's session), raw filter, then decoded filter (a row without decoded data
    fails a non-empty decoded filter)."""
    c = compile_raw(raw_filter)
    if ordinal_start is not None and ordinal_end is not None and ordinal_end >= ordinal_start:
        c = c & F.col("ordinal").between(ordinal_start, ordinal_end)
    elif ordinal_start is not None and ordinal_end is None:
        c = c & (F.col("ordinal") >= ordinal_start)
    elif ordinal_end is not None and ordinal_start is None:
        c = c & (F.col("ordinal") <= ordinal_end)
    if decoded_filter is not None:
        c = c & F.col("signals").isNotNull() & compile_decoded(decoded_filter)
    return rows.filter(c)


class TraceSession:
    """Scan once, then filter and refine without re-reading.

    ``keep=False`` writes no table: the session's results are then computed from the source each time."""

    def __init__(self, frames: DataFrame, dbc: Dbc | None = None, decode: bool = False, keep: bool = True, path: str | None = None):
        base = frames
        if decode:
            if dbc is None:
                raise QueryError("decode requested without a DBC")
            base = decode_nested(frames, dbc, keep_undecoded=True)
        elif "signals" not in base.columns:
            base = base.withColumn("message_name", F.lit(None).cast("string")).withColumn(
                "signals", F.lit(None).cast("array<struct<name:string,value:double>>"))
        self.spark, self.path, self.owned = frames.sparkSession, None, False
        if keep:
            self.path = path or scratch_path(self.spark, "session")
            base.write.parquet(f"{self.path}/rows")
            write_shared_bytes(self.spark, f"{self.path}/OWNER", self.spark.sparkContext.applicationId.encode())
            base, self.owned = self.spark.read.parquet(f"{self.path}/rows"), True
        self.base = self.current = base

    def filter_full(self, **kw) -> DataFrame:
        self.current = row_test(self.base, **kw)
        return self.current

    def refine(self, **kw) -> DataFrame:
        self.current = row_test(self.current, **kw)
        return self.current

    def reset(self) -> DataFrame:
        self.current = self.base
        return self.current

    def close(self) -> None:
        """Remove the table, if this application wrote it."""
        if self.owned:
            delete_shared(self.spark, self.path)
            self.owned = False


def open_session(spark: SparkSession, path: str) -> TraceSession:
    """A session on a table that another one wrote; it is the owner's to remove."""
    rows = spark.read.parquet(f"{path}/rows")
    found = TraceSession(rows, keep=False)
    owner = spark.read.text(f"{path}/OWNER").first()[0]
    found.path, found.owned = path, owner == spark.sparkContext.applicationId
    return found
