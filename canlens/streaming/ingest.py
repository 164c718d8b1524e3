"""Continuous ingest of arriving trace files.

A file-stream source watches a folder.  The stream's own plan parses the lines, so a micro-batch's rows
are read and parsed once; ``foreachBatch`` numbers and writes them:

    lines → parse → (observed metrics) → batch: dense ordinals → raw filter → decode + decoded filter → Parquet

A file is never split across micro-batches, so per-file ordinals stay dense.  The batch's parsed rows are
persisted while it runs: numbering needs counts by split before the rows themselves, and an executor
that is lost has its partitions read again from the same splits.  Each batch writes its own
folders ``batch=<id>`` (frames or signals, and rejected lines) in overwrite mode, so a replayed batch rewrites
the same output.

Live metrics (T2) are *observed* on the stream, under a name of its own, and reach a
``StreamingQueryListener`` with every progress event: frames scanned, frames matched by the raw filter,
lines rejected, lines and bytes read.
"""

from __future__ import annotations

import os
import threading
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..errors import TraceParseError
from ..operators.decode import decode_long, decode_nested, explode_signals
from ..operators.filters import compile_decoded, compile_raw
from ..plans.sizing import join_small
from ..sources.dbc import Dbc
from ..sources.lines import SPLIT_KEYS, dense_positions
from ..sources.traces import FRAME_COLUMNS, parse_lines

#: Files of one micro-batch, at most.
MAX_FILES_PER_TRIGGER = 1000
METRICS = ["scanned", "matched", "rejected", "lines", "bytes"]


class StreamMetrics(StreamingQueryListener):
    """The metrics observed under ``name``, by batch; ``on_batch(batch_id, metrics)`` is called with each."""

    def __init__(self, name: str, on_batch=None):
        self.name, self.on_batch = name, on_batch
        self.batches: dict[int, dict[str, int]] = {}
        self.ended = threading.Event()
        self._run = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self._run = event.progress.runId
            self.batches[event.progress.batchId] = {k: int(found[k] or 0) for k in METRICS}
            if self.on_batch is not None:
                self.on_batch(event.progress.batchId, self.batches[event.progress.batchId])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._run in (None, event.runId):
            self.ended.set()


def observed(parsed: DataFrame, name: str, raw_filter) -> DataFrame:
    """``parsed`` with its metrics observed; a line counts as its bytes and a line end."""
    frame = F.col("is_frame")
    return parsed.observe(
        name, F.count_if(frame).alias("scanned"), F.count_if(frame & compile_raw(raw_filter)).alias("matched"),
        F.count_if(F.col("is_record") & ~frame).alias("rejected"), F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length("value") + 1).alias("bytes"))


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """(trace_id, line_no, text) of a batch's lines that don't parse; ``parsed`` carries ``mid``."""
    splits = parsed.groupBy(*SPLIT_KEYS).agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    bad = parsed.filter(F.col("is_record") & ~F.col("is_frame")).select(*SPLIT_KEYS, "mid", "value")
    return join_small(bad, splits.drop("n"), SPLIT_KEYS).select(
        F.col("file_path").alias("trace_id"), (F.col("base") + F.col("mid") - F.col("first") + 1).alias("line_no"), F.col("value").alias("text"))


def batch_frames(parsed: DataFrame) -> DataFrame:
    """The batch's frames with dense ordinals per file."""
    rows = parsed.filter("is_frame").select("file_path", "block_start", *[c for c in FRAME_COLUMNS if c not in ("trace_id", "ordinal")])
    numbered = dense_positions(rows.withColumn("_rid", F.monotonically_increasing_id()), "ordinal")
    return numbered.withColumn("trace_id", F.col("file_path")).select(*FRAME_COLUMNS)


def start_trace_stream(spark: SparkSession, input_glob: str, fmt: str, output_path: str, checkpoint_path: str,
                       dbc: Dbc | None = None, raw_filter=None, decoded_filter=None, mode: str = "tolerant",
                       available_now: bool = True, max_files_per_trigger: int = MAX_FILES_PER_TRIGGER,
                       rejected_path: str | None = None, on_batch=None):
    """Start the stream; returns ``(StreamingQuery, progress, metrics)``.

    ``progress`` collects one dict per batch (files, rows written); ``metrics`` is the listener with the
    observed metrics.  Lines that don't parse go to ``rejected_path`` (``output_path`` + ``-rejected``);
    ``mode="strict"`` ends the stream at the first of them instead."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(input_glob).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"))
    name = f"trace-ingest-{uuid.uuid4().hex[:8]}"
    rejected_path = rejected_path or output_path.rstrip("/") + "-rejected"
    progress: list[dict] = []

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        parsed = batch.withColumn("mid", F.monotonically_increasing_id()).persist()
        try:
            bad, files = parsed.agg(F.count_if(F.col("is_record") & ~F.col("is_frame")), F.count_distinct("file_path")).first()
            if not files:
                return
            if bad:
                rejected = rejected_lines(parsed)
                if mode == "strict":
                    first = rejected.orderBy("trace_id", "line_no").first()
                    raise TraceParseError(first["trace_id"], int(first["line_no"]), first["text"])
                rejected.write.mode("overwrite").parquet(os.path.join(rejected_path, f"batch={batch_id}"))
            frames = batch_frames(parsed).filter(compile_raw(raw_filter))
            out = frames
            if dbc is not None and decoded_filter is None:
                out = decode_long(frames, dbc)
            elif dbc is not None:
                # Decoded filters test a frame's whole signal list: filter the nested form, then flatten.
                out = explode_signals(decode_nested(frames, dbc).filter(compile_decoded(decoded_filter)))
            obs = Observation(f"batch_{batch_id}")
            out = out.withColumn("batch_id", F.lit(batch_id).cast("bigint")).observe(obs, F.count(F.lit(1)).alias("rows"))
            out.write.mode("overwrite").parquet(os.path.join(output_path, f"batch={batch_id}"))
            progress.append({"batch_id": batch_id, "files": int(files), "rows_written": int(obs.get["rows"])})
        finally:
            parsed.unpersist()

    metrics = StreamMetrics(name, on_batch)
    spark.streams.addListener(metrics)
    writer = observed(parse_lines(lines, fmt), name, raw_filter).writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(), progress, metrics


def run_trace_stream_once(spark: SparkSession, input_glob: str, fmt: str, output_path: str, checkpoint_path: str,
                          **kw) -> tuple[DataFrame, list[dict]]:
    """Process everything available now, wait, and return the sink contents and the progress of each
    batch with its metrics."""
    q, progress, metrics = start_trace_stream(spark, input_glob, fmt, output_path, checkpoint_path, available_now=True, **kw)
    try:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
        metrics.ended.wait(60)  # the listener hears of the last batch a moment later
    finally:
        spark.streams.removeListener(metrics)
    for batch in progress:
        batch |= metrics.batches.get(batch["batch_id"], {})
    return spark.read.parquet(output_path), progress
