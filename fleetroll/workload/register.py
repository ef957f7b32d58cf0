"""Collects queries with their SQL texts, and gives results plain scalar columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is the equivalent text over the same tables."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf: scalars(build(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def address_text(col: str) -> Column:
    a = F.col(col)
    return F.when(
        a.isNotNull(),
        F.concat(
            a["address"]["protocol"], F.lit("://"), a["address"]["system"], F.lit("@"),
            F.coalesce(a["address"]["host"], F.lit("-")), F.lit(":"), a["address"]["port"].cast("string"),
            F.lit("#"), a["long_uid"].cast("string"),
        ),
    )


def map_text(col: str) -> Column:
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
    )


def scalars(df: DataFrame) -> DataFrame:
    """Integers as bigint and times as microseconds, so that any engine returns the same values."""

    def plain(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return micros(f.name).alias(f.name)
        return F.col(f.name)

    return df.select(*[plain(f) for f in df.schema])
