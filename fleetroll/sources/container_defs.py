"""Container definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ACTOR
from ..operators.registry import last_by_key

_TEXTS = T.ArrayType(T.StringType())
_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

_RECORD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("cpus", T.IntegerType()),
        T.StructField("memory", T.IntegerType()),
        T.StructField("actors", T.ArrayType(ACTOR)),
        T.StructField("jvmArgs", _TEXTS),
        T.StructField("jvm-args", _TEXTS),
        T.StructField("jvmProperties", _TEXT_MAP),
        T.StructField("properties", _TEXT_MAP),
        T.StructField("environment", _TEXT_MAP),
        T.StructField("position", T.LongType()),
    ]
)
_BROKEN = "_broken"


def _checked(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Records with the ``message`` of what is wrong with them, null for good ones."""
    schema = T.StructType([*_RECORD.fields, T.StructField(_BROKEN, T.StringType())])
    raw = spark.read.schema(schema).json(path, multiLine=multi_line, columnNameOfCorruptRecord=_BROKEN)
    message = F.when(F.col(_BROKEN).isNotNull(), "malformed record")
    for field in ("name", "cpus", "memory"):
        message = message.when(F.col(field).isNull(), f"missing {field}")
    return raw.withColumn("message", message)


def malformed_container_defs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The records that ``read_container_defs`` leaves out: (record, message).

    A record is malformed when it is no JSON of this shape or lacks its name, cpus or memory.
    """
    record = F.coalesce(_BROKEN, F.to_json(F.struct(*[F.col(f"`{f}`") for f in _RECORD.fieldNames()])))
    return _checked(spark, path, multi_line).where(F.col("message").isNotNull()).select(record.alias("record"), "message")


def read_container_defs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Definition records (JSON) as a typed table with one row per name.

    Both spellings of the argument and property fields are read. Missing ones become empty. Of several definitions with
    one name the last wins: by ``position`` when the records carry it, else by file and line order. Malformed records are in
    ``malformed_container_defs``.
    """
    raw = _checked(spark, path, multi_line).where(F.col("message").isNull())
    no_texts, no_map = F.array().cast(_TEXTS), F.create_map().cast(_TEXT_MAP)
    records = raw.select(
        "name",
        "cpus",
        "memory",
        F.coalesce("actors", F.array().cast(T.ArrayType(ACTOR))).alias("actors"),
        F.coalesce("jvmArgs", "`jvm-args`", no_texts).alias("jvm_args"),
        F.coalesce("jvmProperties", "properties", no_map).alias("jvm_properties"),
        F.coalesce("environment", no_map).alias("environment"),
        F.col("position").alias("_position"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    last = last_by_key(records, "name", ["_position", "_file", "_block", "_line"])
    return last.drop("_position", "_file", "_block", "_line")
