"""Configuration layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layered_config(rows: DataFrame) -> DataFrame:
    """Per ``key`` the row (key, layer, seq, value) of the highest layer (0 first), the latest ``seq`` within it."""
    best = rows.groupBy("key").agg(F.min_by(F.struct("layer", "seq", "value"), F.struct("layer", -F.col("seq"))).alias("b"))
    return best.select("key", "b.*")
