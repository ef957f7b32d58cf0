"""Token files: whole texts as ids in ascending doc_id order, in segments of the adaptive context-mixing range coder.

A file set is a folder of Parquet files that Spark commits. Each row is a segment: the doc ids and sizes of its documents and
the coded ids of ``range_coder``, whose blocks are reset and checksummed one by one. A document is never split between
segments, so a segment holds about ``SEGMENT`` ids or one longer document. Reading decodes segment by segment.

Null text is the empty text (only the end id). Null doc_id sorts first. Rows that repeat a doc_id stay separate documents,
ordered by text. An empty table gives files without rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_path
from . import range_coder
from .common import part_starts
from .tokens import encoder, some_texts, with_end

SEGMENT = 1 << 22

SEGMENTS = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("data", T.BinaryType()),
    ]
)
TOKENS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Encodes ``docs`` (doc_id, text) with the tokenizer file and writes the segments; returns the folder.

    One shuffle by ranges of doc_id puts the documents in order; each task then writes its range as one file.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        names: list = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            nonlocal before, held
            flat, size = np.concatenate(ids), np.concatenate(sizes)
            row = [[part], [before], [len(flat)], [names.copy()], [size], [range_coder.encode(flat)]]
            before += len(flat)
            held = 0
            names.clear(), ids.clear(), sizes.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds)], SEGMENTS.names)

        for batch in batches:
            for some in some_texts(batch):
                new, size = with_end(*enc.encode(some.column("text")), end_id)
                names += some.column("doc_id").to_pylist()
                ids.append(new)
                sizes.append(size)
                held += len(new)
                if held >= SEGMENT:
                    yield segment()
        if names:
            yield segment()

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENTS).write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per document: doc_id, ``start`` (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # A row per file; the number of files is the number of tasks that wrote them.
    segments = segments.join(F.broadcast(part_starts(parts, "part", "n_ids")), "part")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                ids = range_coder.decode(row["data"].as_py())
                sizes = row["sizes"].values.to_numpy()
                ends = np.cumsum(sizes)
                bytes_at = np.concatenate([[0], ends * 4]).astype(np.int32)
                held = pa.Array.from_buffers(
                    pa.binary(), len(sizes), [None, pa.py_buffer(bytes_at), pa.py_buffer(ids.astype("<u4"))]
                )
                start = row["n_ids_before"].as_py() + row["before"].as_py() + ends - sizes
                columns = [row["doc_ids"].values, pa.array(start), pa.array(sizes), held]
                yield pa.record_batch(columns, TOKENS.names)

    return segments.select("n_ids_before", "before", "doc_ids", "sizes", "data").mapInArrow(decode, TOKENS)
