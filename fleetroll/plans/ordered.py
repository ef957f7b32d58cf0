"""Row order within a key, for keys of any size.

``Ordered`` adds columns that depend on the rows before or after a row of its key: ``Before``, ``UpTo``, ``Next``,
``RunningMin`` and ``RunningSum``. While no key is hot each is one plain window function and all of them share one shuffle
and one sort. Rows of a hot key are cut into ranges of the order columns ("slices") that are windowed separately; what must
pass from slice to slice is one small row per slice, scanned on its own and joined back by broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .skew import _HASH, DEFAULT_SKEW, HotKeys, SkewPolicy, find_hot_keys, key_hash

_SLICE = "_slice"
_SAMPLES_PER_SLICE = 20


def _past(window: WindowSpec, inclusive: bool = False) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


@dataclass(frozen=True)
class Scan:
    """A value taken along the rows of a key.

    ``local`` computes it within a slice, ``edge`` sums up a slice for the others, ``carry`` brings the edges of other
    slices to one slice, and ``merge`` puts both together.
    """

    value: Column

    def local(self, rows: WindowSpec) -> Column:
        raise NotImplementedError

    def edge(self, position: Column) -> Column:
        raise NotImplementedError

    def carry(self, edge: Column, slices: WindowSpec) -> Column:
        raise NotImplementedError

    def merge(self, local: Column, carry: Column, rows: WindowSpec) -> Column:
        raise NotImplementedError


class Before(Scan):
    """Last non-null value before the row."""

    inclusive = False

    def local(self, rows):
        return F.last(self.value, ignorenulls=True).over(_past(rows, self.inclusive))

    def edge(self, position):
        return F.max(F.when(self.value.isNotNull(), F.struct(position.alias("p"), self.value.alias("v"))))["v"]

    def carry(self, edge, slices):
        return F.last(edge, ignorenulls=True).over(_past(slices))

    def merge(self, local, carry, rows):
        return F.coalesce(local, carry)


class UpTo(Before):
    """Last non-null value up to and including the row."""

    inclusive = True


class Next(Scan):
    """Value of the row right after this one; null on the last row."""

    def local(self, rows):
        return F.lead(self.value).over(rows)

    def edge(self, position):
        return F.min_by(self.value, position)

    def carry(self, edge, slices):
        return F.lead(edge).over(slices)

    def merge(self, local, carry, rows):
        return F.when(F.lead(F.lit(1)).over(rows).isNull(), carry).otherwise(local)


class RunningMin(Scan):
    """Smallest non-null value up to and including the row."""

    def local(self, rows):
        return F.min(self.value).over(_past(rows, inclusive=True))

    def edge(self, position):
        return F.min(self.value)

    def carry(self, edge, slices):
        return F.min(edge).over(_past(slices))

    def merge(self, local, carry, rows):
        return F.least(local, carry)


class RunningSum(Scan):
    """Sum of the values up to and including the row."""

    def local(self, rows):
        return F.sum(self.value).over(_past(rows, inclusive=True))

    def edge(self, position):
        return F.sum(self.value)

    def carry(self, edge, slices):
        return F.sum(edge).over(_past(slices))

    def merge(self, local, carry, rows):
        return local + F.coalesce(carry, F.lit(0))


class Ordered:
    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        policy: SkewPolicy = DEFAULT_SKEW,
        hot: HotKeys | None = None,
    ):
        """``order`` must be total within a key; use integers or strings, not timestamps. Keys must not be null."""
        self.keys, self.order = list(keys), list(order)
        if hot is None:
            hot = find_hot_keys(df, self.keys, policy)
        self.sliced = bool(hot)
        self._df = _with_slices(df, self.keys, self.order, hot) if hot else df

    @property
    def df(self) -> DataFrame:
        return self._df.drop(_SLICE) if self.sliced else self._df

    def _with(self, df: DataFrame) -> Ordered:
        copy = object.__new__(Ordered)
        copy.keys, copy.order, copy.sliced, copy._df = self.keys, self.order, self.sliced, df
        return copy

    def where(self, condition: Column) -> Ordered:
        return self._with(self._df.where(condition))

    def with_columns(self, **values: Column) -> Ordered:
        return self._with(self._df.withColumns(values))

    def scan(self, **scans: Scan) -> Ordered:
        """Adds one column per scan. Scans that do not need each other's result belong into one call: for hot keys every
        call reads the rows once more to sum up the slices."""
        keys = [*self.keys, _SLICE] if self.sliced else (self.keys or [F.lit(0)])
        rows = Window.partitionBy(*keys).orderBy(*self.order)
        if not self.sliced:
            return self._with(self._df.withColumns({n: s.local(rows) for n, s in scans.items()}))
        position = F.struct(*self.order)
        slices = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(_SLICE)
        edges = (
            self._df.where(F.col(_SLICE).isNotNull())
            .groupBy(*self.keys, _SLICE)
            .agg(*[s.edge(position).alias(f"_carry_{n}") for n, s in scans.items()])
            .select(
                *self.keys,
                _SLICE,
                *[s.carry(F.col(f"_carry_{n}"), slices).alias(f"_carry_{n}") for n, s in scans.items()],
            )
        )
        # One row per slice. Null keys are a group like any other, so they need their carry as well.
        edges = edges.select(*[F.col(c).alias(f"_edge_{c}") for c in [*self.keys, _SLICE]], *[f"_carry_{n}" for n in scans])
        same = F.col(_SLICE) == F.col(f"_edge_{_SLICE}")
        for key in self.keys:
            same = same & F.col(key).eqNullSafe(F.col(f"_edge_{key}"))
        df = self._df.join(F.broadcast(edges), same, "left").drop(*[f"_edge_{c}" for c in [*self.keys, _SLICE]])
        merged = {n: s.merge(s.local(rows), F.col(f"_carry_{n}"), rows) for n, s in scans.items()}
        return self._with(df.withColumns(merged).drop(*[f"_carry_{n}" for n in scans]))


def _with_slices(df: DataFrame, keys: list[str], order: list[str], hot: HotKeys) -> DataFrame:
    """Adds the slice number of every row of a hot key; other rows get null.

    Cut points are order values of a hash sample of the hot rows, about ``_SAMPLES_PER_SLICE`` per slice, so their number
    is bounded by the slice count. A row finds its slice by binary search among the cut points of its key.
    """
    spark = df.sparkSession
    sized = spark.createDataFrame(
        [(h, n, hot.slices(h)) for h, n in sorted(hot.rows.items())], f"{_HASH} bigint, _rows bigint, _slices int"
    )
    sample = (
        df.select(key_hash(keys).alias(_HASH), *order)
        .join(F.broadcast(sized), _HASH)
        .where(F.pmod(F.xxhash64(F.lit(17), *order), F.col("_rows")) < F.col("_slices") * _SAMPLES_PER_SLICE)
        .distinct()  # rows that tie are one place to cut at, so the sample stays bounded whatever the order
        .groupBy(_HASH)
        .agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_sample"))
        .select(
            _HASH,
            F.filter("_sample", lambda _, i: i % _SAMPLES_PER_SLICE == _SAMPLES_PER_SLICE - 1).alias("_cuts"),
        )
    )
    found = sample.collect()  # about one cut point per slice
    cuts = spark.createDataFrame(found, sample.schema)
    located = (
        df.withColumn(_HASH, key_hash(keys))
        .join(F.broadcast(cuts), _HASH, "left")
        .withColumns({"_position": F.struct(*order), "_at": F.when(F.col("_cuts").isNotNull(), F.lit(0))})
    )
    for bit in range(max((len(r["_cuts"]) for r in found), default=0).bit_length() - 1, -1, -1):
        ahead = F.col("_at") + (1 << bit)
        passed = F.get("_cuts", ahead - 1) <= F.col("_position")
        located = located.withColumn("_at", F.when(passed, ahead).otherwise(F.col("_at")))
    # Conditions on the slice are not pushed through a generator, so the search runs once per row.
    return located.select(*df.columns, F.explode(F.array("_at")).alias(_SLICE))
