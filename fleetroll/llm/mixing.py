"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

Every document has a hash of 60 bits. Per source, the words that the mix takes beyond whole repeats form a budget; the documents
whose hashes lie below a threshold fill it. The threshold is found by nested histograms: words summed by source and the hash's
first bits, running totals over at most 2**BITS buckets, then the same for the next bits of the one bucket in which the budget
ends, until the hash's last bit. Nothing is sorted but buckets. A filter on the threshold then gives the mix.

Null text has size 0, null sources are one source, the last. Rows that repeat wholly have one hash: they are taken together or
not at all, whichever is nearer to the budget. Sources without words take none. An empty table gives no rows. Other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, part_starts, saved

BITS, LEVELS = 12, 5
MOST_REPEATS = 3


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(seed: int = 7) -> Column:
    """A document's hash, 0 to 2**60 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 64 - BITS * LEVELS)


def measured(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size and hash of every document, written once."""
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, F.col("source").cast("string").alias("source"))
    return saved(rows.select("doc_id", "source", word_count("text").alias("size"), place(seed).alias("hash")), "sizes")


def _weighted(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, weight: sources in code-point order, null last, take the weights in turn."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    ranged = saved(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    starts = part_starts(ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "n")  # a row per range
    local = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    numbered = ranged.withColumn("local", local).join(F.broadcast(starts), "part")
    turn = F.pmod(F.col("n_before") + F.col("local"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    return numbered.select("source", "source_size", weight.alias("weight"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target: all words shared by weight, at most MOST_REPEATS times a source's size.

    What a source can't take goes to the others by weight, again and again; each turn is one sum over the sources.
    """
    rows = saved(_weighted(sizes, weights), "weights")
    most = F.col("source_size") * MOST_REPEATS
    total, unit = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = total / unit if unit else 0.0
    while True:
        full = most < share * F.col("weight")
        held, unit = rows.agg(
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        again = (total - held) / unit if unit else share
        if again <= share:
            break
        share = again
    return rows.select(
        "source", "source_size", F.least(most.cast("double"), F.lit(float(share)) * F.col("weight")).alias("target")
    )


def thresholds(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target, whole (times that every document is taken), threshold, with_equal.

    A document is taken once more when its hash is below the threshold, or equal to it and ``with_equal``.
    """
    goal = targets(sizes, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.least(F.floor(ratio), F.lit(MOST_REPEATS)).cast("bigint"))
    state = goal.withColumns(
        {
            "budget": F.col("target") - F.col("whole") * F.col("source_size"),
            "below": F.lit(0).cast("bigint"),
            "prefix": F.lit(0).cast("bigint"),
        }
    )
    for level in range(LEVELS):
        rest = BITS * (LEVELS - 1 - level)
        state = saved(state, "threshold")
        inside = sizes.join(
            state.select(F.col("source").alias("s"), "budget", "below", "prefix"),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("hash", rest + BITS) == F.col("prefix")),
        )
        sums = inside.groupBy("s", F.shiftrightunsigned("hash", rest).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("below").alias("below")
        )
        upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("reach", F.col("below") + F.sum("words").over(upto))
        # Each source's first bucket in which the budget ends.
        border = sums.where("reach > budget").groupBy("s").agg(
            F.min(F.struct("bucket", (F.col("reach") - F.col("words")).alias("below"), "words")).alias("border")
        )
        state = state.drop("below", "prefix").join(border, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "whole", "budget",
            F.coalesce("border.below", F.lit(0)).alias("below"), F.coalesce("border.bucket", F.lit(0)).alias("prefix"),
            F.coalesce("border.words", F.lit(0)).alias("words"),
        )
    nearer = F.col("below") + F.col("words") - F.col("budget") < F.col("budget") - F.col("below")
    return saved(
        state.select("source", "source_size", "target", "whole", F.col("prefix").alias("threshold"), nearer.alias("with_equal")),
        "thresholds",
    )


def times(hashed: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with source and hash, plus source_size, target and ``times`` (how often the mix takes the row)."""
    limits = limits.withColumnRenamed("source", "s")
    below = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("with_equal"))
    return (
        hashed.join(limits, F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("times", F.col("whole") + F.when(F.col("whole") < MOST_REPEATS, below.cast("bigint")).otherwise(0))
        .drop("s", "whole", "threshold", "with_equal")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken of every document."""
    sizes = measured(docs, seed)
    return times(sizes, thresholds(sizes, weights)).withColumn("taken", F.col("times") * F.col("size")).drop("hash")
