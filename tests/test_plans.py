"""Splitting hot keys never changes a result, and it does split."""

import pytest
from pyspark.sql import functions as F

from fleetroll.plans import (
    DEFAULT_SKEW,
    Before,
    HotKeys,
    Next,
    Ordered,
    RunningMin,
    RunningSum,
    SkewPolicy,
    UpTo,
    find_hot_keys,
    skew_join,
    skew_join_both,
)
from fleetroll.plans.ordered import _SLICE

POLICY = SkewPolicy(group_rows=100, probe_bytes=0, sketch_buckets=8)


@pytest.fixture(scope="module")
def skewed(spark):
    """6000 rows; a third of them belong to key 0, and half of those share one time."""
    n = F.col("id")
    return spark.range(6000).select(
        F.when(n % 3 == 0, 0).otherwise(1 + n % 97).alias("k"),
        F.when(n % 2 == 0, 50).otherwise(F.pmod(F.hash("id"), F.lit(100))).alias("t"),
        n.alias("id"),
        F.when(n % 5 == 0, n).alias("v"),
    )


def test_hot_keys_are_found_and_bounded(skewed):
    hot = find_hot_keys(skewed, ["k"], POLICY)
    assert [n for n in hot.rows.values()] == [2000]
    assert not find_hot_keys(skewed, ["k"])  # too small to bother by default
    assert find_hot_keys(skewed, [], POLICY).rows == {0: 6000}


def test_slices_are_even(skewed):
    ordered = Ordered(skewed, ["k"], ["t", "id"], POLICY)
    sizes = [r["count"] for r in ordered._df.where(f"{_SLICE} is not null").groupBy(_SLICE).count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 8 and max(sizes) < 600


@pytest.mark.parametrize("keys", [["k"], []])
def test_ordered_equals_plain_windows(skewed, keys):
    def run(policy):
        return (
            Ordered(skewed, keys, ["t", "id"], policy)
            .scan(p=Before(F.col("v")), q=Before(F.when(F.col("id") % 7 == 0, F.struct("t", "id"))), i=UpTo(F.col("v")))
            .scan(n=Next(F.col("v")), s=RunningSum(F.col("id")), x=RunningMin(F.col("v")))
            .where(F.col("id") % 4 != 0)
            .scan(m=Next(F.col("id")))
        )

    plain, split = run(DEFAULT_SKEW), run(POLICY)
    assert split.sliced and not plain.sliced
    assert sorted(map(str, plain.df.collect())) == sorted(map(str, split.df.collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, skewed, how):
    right = spark.range(0, 60, 2).select(F.col("id").alias("k"), F.col("id").alias("w"))
    plain = skewed.join(right, "k", how)
    split = skew_join(skewed, right, ["k"], how, POLICY)
    assert split.columns == plain.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_skew_join_both_equals_join(spark, skewed):
    right = spark.range(900).select(F.when(F.col("id") < 300, 5).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("w"))
    plain = skewed.join(right, "k")
    split = skew_join_both(skewed, right, ["k"], POLICY)
    assert split.count() == plain.count()
    assert split.select(F.sum(F.hash("k", "t", "id", "w").cast("bigint"))).first() == plain.select(F.sum(F.hash("k", "t", "id", "w").cast("bigint"))).first()


def test_hot_rows_are_spread(spark, skewed):
    """No shuffle partition of the salted join holds the whole hot key."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        right = spark.range(100).select(F.col("id").alias("k"))
        joined = skew_join(skewed, right, ["k"], "inner", POLICY).withColumn("part", F.spark_partition_id())
        assert joined.where("k = 0").groupBy("part").count().agg(F.max("count")).first()[0] < 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_map_columns_can_be_salted(spark):
    left = spark.range(1000).select(F.lit(1).alias("k"), F.col("id"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    right = spark.createDataFrame([(1, "x")], "k int, w string")
    assert skew_join(left, right, ["k"], "left", POLICY).where("w = 'x'").count() == 1000


def test_given_hot_keys_are_used(spark, skewed):
    hot = HotKeys({skewed.select(F.xxhash64(F.lit(0))).first()[0]: 2000}, 100)
    assert hot.slices(next(iter(hot.rows))) == 20
    assert Ordered(skewed, ["k"], ["t", "id"], hot=hot).sliced


def test_a_table_without_keys_is_cut_by_its_rows(spark):
    """However few bytes Catalyst expects, no task gets all rows."""
    policy = SkewPolicy(group_rows=1000)
    rows = Ordered(spark.range(5000), [], ["id"], policy)
    assert rows.sliced
    got = rows.scan(nth=RunningSum(F.lit(1))).df
    assert got.where(F.col("nth") != F.col("id") + 1).count() == 0
    assert not Ordered(spark.range(999), [], ["id"], policy).sliced
