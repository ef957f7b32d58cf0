"""What several operators share: intermediate tables, row ids, running totals over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.scratch import scratch_path

#: Word characters of all contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, and later reads see sizes and one fixed order."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Named columns only, under a row id ``uid``; for one job, see ``numbered_once``.

    Rows that repeat stay apart. Ids follow the partitions of the scan, and those depend on the cores registered when a job is
    planned, so two jobs may give a row two ids.
    """
    return df.select(F.monotonically_increasing_id().alias("uid"), *columns)


def numbered_once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``numbered`` rows written down, so all jobs that read them agree on the ids."""
    return saved(numbered(df, *columns), "rows")


def part_starts(parts: DataFrame, part: str, *values: str) -> DataFrame:
    """Sums of ``values`` over all smaller ``part`` numbers. ``parts`` has a row per partition, so one task may order it."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(part, *[F.coalesce(F.sum(v).over(before), F.lit(0)).cast("bigint").alias(f"{v}_before") for v in values])


def with_columns(schema: T.StructType, **extra: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(k, v) for k, v in extra.items()]])
