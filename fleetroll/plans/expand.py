"""Turning a count into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 10_000
SPREAD_ABOVE = 1_000_000


def largest_count(df: DataFrame, count: str) -> int:
    return df.agg(F.max(count)).first()[0] or 0


def explode_ordinals(df: DataFrame, count: str, name: str, largest: int, spread_by: list[str]) -> DataFrame:
    """Rows ``1..count`` for every input row, none for zero or less; ``name`` is the ordinal.

    The expansion goes through chunks, so no array grows with the count. When the ``largest`` count is high the chunks are
    first spread over the cluster by ``spread_by``; ordinary inputs are not shuffled.
    """
    chunks = df.where(F.col(count) > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.expr(f"cast(({count} - 1) div {CHUNK} as int)")))
    )
    if largest > SPREAD_ABOVE:
        chunks = chunks.repartition(*spread_by, "_chunk")
    first = F.col("_chunk") * CHUNK + 1
    last = F.least(F.col(count).cast("int"), first + CHUNK - 1)
    return chunks.withColumn(name, F.explode(F.sequence(first, last))).drop("_chunk")
