"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A file is a run of frames, in ascending document order within and across files (by the number in
their name, which isn't the order of the names themselves from 100,000 files on):

    length of the payload   8 bytes, little-endian
    checksum of those 8     4 bytes, masked CRC-32
    payload                 document id (8), has-id flag (1), bytes per id (1), the ids
    checksum of the payload 4 bytes, masked CRC-32
    0x0A                    1 byte

A masked checksum is the CRC-32 rotated right by 15 bits plus a constant, so that a checksum
over data that hold checksums stays sound.  The files are written by Spark's text sink (each
row is one frame, the sink's line separator is the closing byte), so they go to any folder
Spark reaches, with its commit protocol; they are read as ``binaryFile``.  The index is a
Parquet table beside them, made by reading every frame back and checking its checksums:
doc_id, file, record, offset, length, n_tokens, start, ids_crc32.

Null text counts as empty: the record holds the end id alone.  Rows with a null id come first
and keep it null; repeated rows are records of their own, equal ids in the order of their
texts; other columns are left out; an empty table gives no records.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import partitions_for, ready, small, small_lists, texts_of, tidy, written

#: Bytes of input a data file is made from; a file must fit in a task's memory.
FILE_BYTES = 8 << 20
#: Distinct pre-tokens kept per Python worker: more than the default, as this query does little else.
MEMO = 700_000
_MASK = 0xA282EAD8
_LENGTH, _SUM, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")
_FRAME = _LENGTH.size + 2 * _SUM.size + 1
INDEX = "doc_id bigint, file string, record bigint, offset bigint, length bigint, n_tokens bigint, start bigint, ids_crc32 bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without its closing byte (which the text sink writes)."""
    payload = _HEAD.pack(doc_id or 0, doc_id is not None, ids.dtype.itemsize) + ids.tobytes()
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload))))


def read_frame(data: memoryview, offset: int, check: bool = True) -> tuple[int | None, np.ndarray, int]:
    """Document id, ids and size of the record at ``offset``; ValueError if it is damaged."""
    head = data[offset: offset + _LENGTH.size + _SUM.size]
    if len(head) < _LENGTH.size + _SUM.size or masked(head[:8]) != _SUM.unpack(head[8:])[0]:
        raise ValueError(f"damaged record length at byte {offset}")
    n = _LENGTH.unpack(head[:8])[0]
    payload = data[offset + 12: offset + 12 + n]
    tail = data[offset + 12 + n: offset + n + _FRAME]
    if len(payload) < n or len(tail) < 5 or tail[4] != 0x0A or check and masked(payload) != _SUM.unpack(tail[:4])[0]:
        raise ValueError(f"damaged record at byte {offset}")
    doc_id, has, width = _HEAD.unpack(payload[: _HEAD.size])
    ids = np.frombuffer(payload[_HEAD.size:], dtype="<u2" if width == 2 else "<u4")
    return doc_id if has else None, ids, n + _FRAME


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row and write ``path``/data and ``path``/index."""
    spark = ready(docs.sparkSession)
    source = spark.sparkContext.broadcast(bpe.read_tokenizer(tokenizer_path))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.repartitionByRange(partitions_for(docs, FILE_BYTES), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = bpe.encoder(bpe.ByteIds, source.value, MEMO)
        end = np.array([end_id], dtype=ids.dtype).tobytes()
        for batch in parts:
            pairs = zip(batch.column("doc_id").to_pylist(), ids.pieces(texts_of(batch)), strict=True)
            frames = [frame(doc, np.frombuffer(raw + end, ids.dtype)) for doc, raw in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = rows.mapInArrow(tidy(encode, keeps=True), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")
    # the index comes from reading the files back, so it stands for what they hold
    read = written(scan(spark, path), "records-read")
    with_starts(read).select(*spark.createDataFrame([], INDEX).columns).write.parquet(f"{path}/index")


def data_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def scan(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """All records of all files; ``before``: ids in the records before it in its file."""
    ready(spark)

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                found: list[tuple] = []
                at = before = 0
                while at < len(data):
                    doc, ids, size = read_frame(data, at, check)
                    crc = zlib.crc32(ids.astype("<u4").tobytes()) if check else 0
                    found.append((doc, name, len(found), at, size, len(ids), before, crc))
                    at, before = at + size, before + len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 8, kinds, strict=True)], names=names)

    names = ["doc_id", "file", "record", "offset", "length", "n_tokens", "before", "ids_crc32"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
    return data_files(spark, path).mapInArrow(tidy(parse, keeps=True), "doc_id bigint, file string, record bigint, offset bigint, length bigint, n_tokens bigint, before bigint, ids_crc32 bigint")


def with_starts(records: DataFrame) -> DataFrame:
    """Add ``start``: ids of all records before, by one running sum over the files' totals."""
    totals = records.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    # Spark pads the numbers to five and three digits, so longer ones sort wrongly as text
    part, piece = (F.regexp_extract("file", digits, 1).try_cast("bigint") for digits in (r"^part-(\d+)", r"-c(\d+)[^-]*$"))
    order = Window.orderBy(part, piece, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    base = totals.select("file", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))
    return records.join(small(base), "file").withColumn("start", F.col("base") + F.col("before"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """Records in a random order given by ``seed``: ``rank`` (sort by it), doc_id, ids.

    The index alone decides the order; each file's records are then cut out at the index's
    offsets, in the order of their ranks."""
    ranked = read_index(spark, path).withColumn("rank", F.xxhash64(F.lit(seed), "file", "record"))
    wanted = written(ranked.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("rank", "offset"))).alias("wanted")), "wanted")

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for wants, content in zip(batch.column("wanted").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                for lo in range(0, len(wants), 256):
                    got = [(w["rank"], *read_frame(data, w["offset"])[:2]) for w in wants[lo: lo + 256]]
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2].tolist() for g in got], pa.list_(pa.int32()))], names=["rank", "doc_id", "ids"])

    joined = data_files(ready(spark), path).join(small_lists(wanted, "wanted"), "file").select("wanted", "content")
    return joined.mapInArrow(tidy(pick, keeps=True), "rank bigint, doc_id bigint, ids array<int>").orderBy("rank")
