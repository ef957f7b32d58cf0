"""A registry table that a stream keeps up to date.

Layout below ``path``: ``base/v=<n>`` holds the whole table as of version ``n``; ``delta/v=<n>`` the latest row per id
of one batch alone. A micro-batch writes only its own delta, so its cost follows the batch and not the table, and writing
a batch again after a failure replaces the same folder. Reading merges the newest base with the deltas after it;
compaction writes a new base. A version counts once its ``_SUCCESS`` marker is there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators.registry import last_by_key


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in done)


def _parts(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    bases = _versions(spark, f"{path}/base")
    base = bases[-1] if bases else -1
    deltas = [v for v in _versions(spark, f"{path}/delta") if v > base]
    folders = [f"{path}/base/v={base}"] if bases else []
    return max([base, *deltas]), folders + [f"{path}/delta/v={v}" for v in deltas]


def write_delta(batch: DataFrame, batch_id: int, path: str, order: Sequence[str] = ("ts", "event_id")) -> None:
    last_by_key(batch, "instance_id", order).write.mode("overwrite").parquet(f"{path}/delta/v={batch_id}")


def upsert_registry(stream: DataFrame, path: str, order: Sequence[str] = ("ts", "event_id")) -> DataStreamWriter:
    """Writer that keeps the latest row per ``instance_id``; start it with a trigger and a checkpoint location."""
    # Batch ids begin at 0 again with a new checkpoint; versions go on after those that are there, so none is written over or
    # hidden by an older base. A batch that is written twice has the same rows, and reading keeps one per id.
    first = _parts(stream.sparkSession, path)[0] + 1
    return stream.writeStream.outputMode("append").foreachBatch(
        lambda batch, batch_id: write_delta(batch, first + batch_id, path, order)
    )


def read_registry(spark: SparkSession, path: str, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    _, folders = _parts(spark, path)
    if not folders:
        raise FileNotFoundError(f"no registry version below {path}")
    return last_by_key(spark.read.parquet(*folders), "instance_id", order)


def compact_registry(spark: SparkSession, path: str, order: Sequence[str] = ("ts", "event_id")) -> int:
    """Writes the merged table as a new base and returns its version."""
    version, folders = _parts(spark, path)
    if len(folders) > 1 or any("/delta/" in f for f in folders):
        merged = last_by_key(spark.read.parquet(*folders), "instance_id", order)
        merged.write.mode("overwrite").parquet(f"{path}/base/v={version}")
    return version
