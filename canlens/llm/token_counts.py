"""Token counts of whole texts with the whole-token shortcut (see ``bpe.WordCounts``).

Row by row, no shuffle.  Null text counts as empty (0 bytes, 0 tokens); any other columns of
the input are left out, so clashing names do no harm; repeated rows give repeated results;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import ready, texts_of, tidy


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens)."""
    spark = ready(docs.sparkSession)
    source = spark.sparkContext.broadcast(bpe.read_tokenizer(tokenizer_path))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.encoder(bpe.WordCounts, source.value)
        for batch in parts:
            texts = texts_of(batch)
            n = list(words.pieces(texts))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(x) if x.isascii() else len(x.encode()) for x in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_()),
            ], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(tidy(count, keeps=True), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
