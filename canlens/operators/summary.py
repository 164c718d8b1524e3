"""Result summaries.  All are aggregates with map-side partial
aggregation; the distinct lists are bounded by the id / channel domain, not by rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_bounds(rows: DataFrame) -> DataFrame:
    """Count, min/max timestamp and, if the rows carry it, the source format per trace (A2)."""
    formats = [F.first("source_format").alias("source_format")] if "source_format" in rows.columns else []
    return rows.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("timestamp_ns").alias("start_timestamp_ns"),
        F.max("timestamp_ns").alias("end_timestamp_ns"),
        *formats,
    )


def distinct_channels(rows: DataFrame) -> DataFrame:
    """Sorted distinct channels (A3)."""
    return rows.select("channel").distinct().orderBy("channel")


def distinct_ids(rows: DataFrame) -> DataFrame:
    """Sorted distinct ids (A4)."""
    return rows.select("can_id").distinct().orderBy("can_id")


def any_decoded(rows: DataFrame) -> DataFrame:
    """Whether any row carries a decoded message (A5)."""
    return rows.agg(F.coalesce(F.bool_or(F.col("message_name").isNotNull()), F.lit(False)).alias("any_decoded"))


def chunk_summary(frames: DataFrame, chunk_size: int, *more: Column) -> DataFrame:
    """Per chunk of ``chunk_size`` ordinals: count, first and last timestamp in order (A6), and
    further aggregates if given."""
    return (
        frames.withColumn("chunk_id", F.floor(F.col("ordinal") / chunk_size).cast("bigint"))
        .groupBy("trace_id", "chunk_id")
        .agg(F.count(F.lit(1)).alias("event_count"),
             F.min_by("timestamp_ns", "ordinal").alias("first_timestamp_ns"),
             F.max_by("timestamp_ns", "ordinal").alias("last_timestamp_ns"), *more)
    )


def cache_summary(chunks: DataFrame) -> DataFrame:
    """Whole-store summary from chunk summaries: total count, start of the first chunk,
    end of the last chunk (A7)."""
    return chunks.groupBy("trace_id").agg(
        F.sum("event_count").cast("bigint").alias("event_count"),
        F.min_by("first_timestamp_ns", "chunk_id").alias("start_timestamp_ns"),
        F.max_by("last_timestamp_ns", "chunk_id").alias("end_timestamp_ns"),
        F.count(F.lit(1)).alias("chunk_count"),
    )
