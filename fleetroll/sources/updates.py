"""Streams of status updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPDATE = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)
# A message is one update, or a batch of them.
MESSAGE = T.StructType([*UPDATE.fields, T.StructField("updates", T.ArrayType(UPDATE))])
_BROKEN = "_broken"


def _single(spark: SparkSession, path: str, files_per_batch: int | None) -> DataFrame:
    """(update, _broken): single updates, and the text of messages that are no JSON of this shape."""
    reader = spark.readStream.schema(T.StructType([*MESSAGE.fields, T.StructField(_BROKEN, T.StringType())]))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    single = F.struct(*[F.col(f.name) for f in UPDATE])
    messages = reader.json(path, columnNameOfCorruptRecord=_BROKEN)
    return messages.select(F.explode(F.coalesce("updates", F.array(single))).alias("update"), _BROKEN)


def malformed_updates(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """What ``stream_updates`` leaves out, as a stream (record, message): unreadable messages and updates without an id."""
    message = F.when(F.col(_BROKEN).isNotNull(), "malformed message").when(
        F.col("update.instance_id").isNull(), "missing instance_id"
    )
    records = _single(spark, path, files_per_batch).withColumn("message", message).where(F.col("message").isNotNull())
    return records.select(F.coalesce(_BROKEN, F.to_json("update")).alias("record"), "message")


def stream_updates(
    spark: SparkSession, path: str, watermark: str = "1 hour", files_per_batch: int | None = None
) -> DataFrame:
    """JSON messages below ``path`` as a stream of single updates with a watermark on ``ts``.

    ``files_per_batch`` bounds the size of a micro-batch. Messages that can't be read are in ``malformed_updates``.
    """
    updates = _single(spark, path, files_per_batch).where(F.col(_BROKEN).isNull())
    return updates.select("update.*").where(F.col("instance_id").isNotNull()).withWatermark("ts", watermark)
