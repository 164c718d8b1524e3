"""Sinks: CSV (raw and decoded), Parquet, callbacks and text rendering.

Formatting is column expressions; writing is Spark's own writers (parallel, one file per
task).  The exported-row count comes from an ``Observation`` on the written DataFrame, so
it costs no extra pass.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import format_g6, hex_upper, payload_spaced_hex
from ..sources.lines import materialize

# Export headers.
RAW_HEADER = ["timestamp_ns", "channel", "can_id", "dlc", "payload", "frame_type"]
DECODED_HEADER = ["timestamp_ns", "can_id", "message_name", "signal_name", "signal_value", "unit"]


def raw_rows(frames: DataFrame) -> DataFrame:
    """Frames in raw-export text form (K1)."""
    return frames.select(
        F.col("timestamp_ns").cast("string").alias("timestamp_ns"),
        F.col("channel").cast("string").alias("channel"),
        hex_upper("can_id").alias("can_id"),
        F.col("dlc").cast("string").alias("dlc"),
        payload_spaced_hex("payload").alias("payload"),
        F.when(F.col("frame_type") == 1, F.lit("FD")).otherwise(F.lit("CAN")).alias("frame_type"),
    )


def decoded_rows(signals_long: DataFrame, full_precision: bool = False) -> DataFrame:
    """Long decoded rows in export text form (K2); values as the reference prints them
    (6 significant digits) unless ``full_precision``."""
    value = F.col("value").cast("string") if full_precision else format_g6("value")
    return signals_long.select(
        F.col("timestamp_ns").cast("string").alias("timestamp_ns"),
        hex_upper("can_id").alias("can_id"),
        F.col("message_name"),
        F.col("signal_name"),
        value.alias("signal_value"),
        F.coalesce(F.col("unit"), F.lit("")).alias("unit"),
    )


def _write(df: DataFrame, path: str, fmt: str, header: bool, mode: str) -> int:
    obs = Observation(f"export_{fmt}")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode(mode)
    if fmt == "csv":
        w.option("header", str(header).lower()).option("emptyValue", "").csv(path)
    else:
        w.format(fmt).save(path)
    return int(obs.get["rows"])


def export_raw_csv(frames: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> int:
    """Write the raw CSV export; returns the number of rows written."""
    return _write(raw_rows(frames), path, "csv", header, mode)


def export_decoded_csv(signals_long: DataFrame, path: str, header: bool = True, mode: str = "overwrite",
                       full_precision: bool = False) -> int:
    """Write the decoded CSV export, one row per signal (K2, K4); returns rows written."""
    return _write(decoded_rows(signals_long, full_precision), path, "csv", header, mode)


def export_parquet(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> int:
    """Columnar export (K6): Parquet or ORC."""
    return _write(df, path, fmt, True, mode)


def for_each_match(df: DataFrame, callback) -> None:
    """Call ``callback(row)`` for every row, on the executors, a partition at a time (K5)."""

    def each(rows):
        for row in rows:
            callback(row)

    df.foreachPartition(each)


def for_each_batch(df: DataFrame, write, commit=None) -> DataFrame:
    """Hand the rows to ``write(batch, partition, attempt)`` as Arrow batches, on the executors (K5).

    A task that is retried calls ``write`` again, with the next attempt.  What counts is what its partition
    *commits*: each task ends with one ledger row, the ledger is written through Spark's output commit, which
    keeps the rows of one successful attempt of each partition, and ``commit(partition, attempt)`` is then called on
    the driver for each of them.  So a sink that stages by (partition, attempt) and publishes on commit
    takes every row once.  Returns the ledger: partition, attempt, rows, and the sum of what ``write`` returned
    (a number or None) as ``handled``."""

    def run(batches):
        context = TaskContext.get()
        partition, attempt = context.partitionId(), context.attemptNumber()
        rows, handled = 0, 0
        for batch in batches:
            handled += int(write(batch, partition, attempt) or 0)
            rows += batch.num_rows
        yield pa.RecordBatch.from_pydict({"partition": [partition], "attempt": [attempt], "rows": [rows], "handled": [handled]})

    ledger = materialize(df.mapInArrow(run, "partition bigint, attempt bigint, rows bigint, handled bigint"), "ledger")
    if commit is not None:
        for row in ledger.orderBy("partition").toLocalIterator():  # one row per partition
            commit(row["partition"], row["attempt"])
    return ledger


def render_frame_text(frames: DataFrame) -> DataFrame:
    """``[ordinal] ts=.. can_id=0x.. dlc=.. ch=.. data=..`` per frame."""
    return frames.select(
        "trace_id", "ordinal",
        F.format_string("[%d] ts=%d can_id=0x%s dlc=%d ch=%d data=%s", F.col("ordinal"), F.col("timestamp_ns"),
                        hex_upper("can_id"), F.col("dlc"), F.col("channel"),
                        payload_spaced_hex("payload")).alias("text"))


def render_signal_text(signals_long: DataFrame) -> DataFrame:
    """``name = value (label) unit`` per decoded signal (K7)."""
    label = F.when(F.col("value_description").isNotNull(), F.concat(F.lit(" ("), F.col("value_description"), F.lit(")"))
                   ).otherwise(F.lit(""))
    unit = F.when(F.coalesce(F.col("unit"), F.lit("")) != "", F.concat(F.lit(" "), F.col("unit"))).otherwise(F.lit(""))
    return signals_long.select(
        "trace_id", "ordinal", "signal_index",
        F.concat(F.col("signal_name"), F.lit(" = "), F.coalesce(format_g6("value"), F.lit("")), label, unit).alias("text"))
