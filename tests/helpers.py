"""Small tables for tests. Times are given in seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetroll.model import REGISTRY
from fleetroll.plans import SkewPolicy

# Every group of a few rows counts as hot.
SPLIT = SkewPolicy(group_rows=3, probe_bytes=0, sketch_buckets=4)


def table(spark: SparkSession, rows: list, schema: str, *ts: str) -> DataFrame:
    """Rows with the named columns turned from seconds into timestamps."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.timestamp_micros((F.col(c) * 1_000_000).cast("bigint")) for c in ts})


def seconds(df: DataFrame) -> list[tuple]:
    """Sorted rows with timestamps as seconds."""
    columns = [
        (F.unix_micros(f.name) / 1_000_000).alias(f.name) if f.dataType.simpleString() == "timestamp" else F.col(f.name)
        for f in df.schema
    ]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def address(uid: int, host: str | None = "localhost"):
    return (("tcp", "fleet", host, 2550), uid)


def instance(i: str, container: str, status: str, roles=("role",), addr=None):
    return (i, container, (status, list(roles), addr, ["/user/actor"], {}))


def registry(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, REGISTRY)


def ids(df: DataFrame, column: str = "instance_id") -> set:
    return {r[0] for r in df.select(column).collect()}
