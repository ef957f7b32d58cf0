"""Connected components of links, as joins and sums of the links' own size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) for links (a, b).

    Alternates two steps until nothing changes: every node points its larger neighbours, or its smaller ones and itself, to the
    smallest node next to it. Components shrink to stars in a number of turns that grows with the logarithm of their size.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        before = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = saved(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "small-star",
        )
        if _sums(edges) == _sums(before):
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    return saved(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "labels")


def _sums(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())
