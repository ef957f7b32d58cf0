"""Hot keys: find them with a bounded sketch, then split their rows over many tasks.

A window or a shuffled join sends all rows of one key to one task. That is fine until one key holds a large share of the
table. ``find_hot_keys`` measures this with one scan of the key columns: every task keeps fixed-size heavy-hitter
sketches, so nothing that grows with the data is shuffled or collected. Without hot keys the operators keep their plain
one-shuffle plan; with hot keys ``skew_join`` salts them and ``Ordered`` range-splits them. Both give exact results for
any split; the sketch only decides where to cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HASH = "_key_hash"
_SALT = "_salt"


@dataclass(frozen=True)
class SkewPolicy:
    """When a key counts as hot, and how fine its rows are split.

    Inputs that Catalyst estimates below ``probe_bytes`` are not probed: even a single task can hold them whole. An input
    without keys, where a single task gets all rows, is counted in any case.
    """

    group_rows: int = 2_000_000
    probe_bytes: int = 256 << 20
    sketch_buckets: int = 64
    sketch_items: int = 4096
    reported_items: int = 512


DEFAULT_SKEW = SkewPolicy()


@dataclass(frozen=True)
class HotKeys:
    """Key hashes with their row counts; at most ``sketch_buckets * reported_items`` of them, however large the data."""

    rows: dict[int, int] = field(default_factory=dict)
    slice_rows: int = 1

    def __bool__(self) -> bool:
        return bool(self.rows)

    def slices(self, key_hash: int) -> int:
        return max(2, -(-self.rows[key_hash] // self.slice_rows))

    def table(self, spark: SparkSession) -> DataFrame:
        """(hash, number of slices), small enough to broadcast by construction."""
        pairs = [(h, self.slices(h)) for h in sorted(self.rows)]
        return F.broadcast(spark.createDataFrame(pairs, f"{_HASH} bigint, _slices int"))


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")


def find_hot_keys(df: DataFrame, keys: Sequence[str], policy: SkewPolicy = DEFAULT_SKEW) -> HotKeys:
    """Keys with at least ``group_rows`` rows, found in one pass that combines map-side."""
    if not keys:  # one group whatever its size; an estimate in bytes says little about the rows of a narrow column
        total = df.count()
        hot = {0: total} if total >= policy.group_rows else {}
    elif estimated_bytes(df) < policy.probe_bytes:
        return HotKeys()
    else:
        sketched = (
            df.select(key_hash(keys).alias("h"))
            .groupBy(F.pmod("h", F.lit(policy.sketch_buckets)).alias("bucket"))
            .agg(
                F.expr(f"approx_top_k(h, {policy.reported_items}, {policy.sketch_items})").alias("top"),
            )
            .select(F.filter("top", lambda t: t["count"] >= policy.group_rows).alias("top"))
            .collect()  # one row per sketch bucket
        )
        hot = {t["item"]: t["count"] for r in sketched for t in r["top"]}
    return HotKeys(hot, max(policy.group_rows, 1))


def _spread(df: DataFrame) -> Column:
    """Hash of the row without its map columns, which Spark cannot hash."""
    return F.hash(*[f.name for f in df.schema if "map<" not in f.dataType.simpleString()])


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    policy: SkewPolicy = DEFAULT_SKEW,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Equi-join of a possibly skewed ``left`` with a ``right`` that has few rows per key.

    Hot keys of ``left`` are salted by a hash of the row (stable when a lost task is run again) and only the matching
    rows of ``right`` are copied, once per salt. ``how`` is any of left, inner, left_semi, left_anti.
    """
    on = list(on)
    if hot is None:
        hot = find_hot_keys(left, on, policy)
    if not hot:
        return left.join(right, on, how)
    salted = _salted(left, on, hot, _SALT)
    return salted.join(_copied(right, on, hot, _SALT), [*on, _SALT], how).drop(_SALT)


def skew_join_both(left: DataFrame, right: DataFrame, on: Sequence[str], policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Inner equi-join where a key may hold many rows on either side: hot keys are cut on each side they are hot on."""
    on = list(on)
    hot_left, hot_right = find_hot_keys(left, on, policy), find_hot_keys(right, on, policy)
    keys = list(on)
    if hot_left:
        left, right = _salted(left, on, hot_left, _SALT), _copied(right, on, hot_left, _SALT)
        keys.append(_SALT)
    if hot_right:
        left, right = _copied(left, on, hot_right, _SALT + "_r"), _salted(right, on, hot_right, _SALT + "_r")
        keys.append(_SALT + "_r")
    return left.join(right, keys).drop(*keys[len(on) :])


def _salted(df: DataFrame, on: list[str], hot: HotKeys, salt: str) -> DataFrame:
    return (
        df.withColumn(_HASH, key_hash(on))
        .join(hot.table(df.sparkSession), _HASH, "left")
        .withColumn(salt, F.coalesce(F.pmod(_spread(df), F.col("_slices")), F.lit(0)))
        .drop(_HASH, "_slices")
    )


def _copied(df: DataFrame, on: list[str], hot: HotKeys, salt: str) -> DataFrame:
    return (
        df.withColumn(_HASH, key_hash(on))
        .join(hot.table(df.sparkSession), _HASH, "left")
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)))
        .drop(_HASH, "_slices")
    )
