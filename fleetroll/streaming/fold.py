"""Folding the events of a key in event-time order, whatever order they arrive in.

Ids are dealt to buckets. Events travel and wait as Arrow batches, one for a bucket: every task of a micro-batch first packs its
events by bucket, a stateful processor files the packed events of its bucket unread, and once the watermark has passed the end
of a time slot it reads, sorts and folds them by array operations, so no Python runs and no state is kept per event. What a fold
gives is packed again, and read into rows behind the processor.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.timing import micros

#: Width of a time slot: results wait for the end of their slot.
SLOT = 60.0
#: Buckets of keys. What a bucket holds is read and written together, so there should be one bucket for every 16 to 250 live keys.
BUCKETS = 1 << 16
#: Events, and bytes of them, that a task packs together.
PACK_ROWS, PACK_BYTES = 1 << 20, 64 << 20
#: Results packed into one batch.
ROW_VALUES = 100_000

PACKED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("us", T.LongType()), T.StructField("data", T.BinaryType())])


class Fold:
    """A rule that folds the events of closed slots of a key into a state tuple, with one open deadline per key.

    ``fold(state, *columns)`` gets the arrays of a key's events in order and returns the new state and output lists (or None);
    ``deadline(state)`` is the time (microseconds) after which ``expire(state)`` applies, or None. An event right on a deadline
    still comes first, so a deadline is safe once the slot that holds it is closed. A key in the ``start`` state takes no space.
    """

    #: "name type, ..." of a state, of the events' columns (names only), and of the output without the key.
    state_schema = ""
    start: tuple = ()
    columns: list[str] = []
    output_schema = ""

    def deadline(self, state: tuple) -> int | None:
        raise NotImplementedError

    def fold(self, state: tuple, *columns: np.ndarray) -> tuple[tuple, list[list] | None]:
        raise NotImplementedError

    def expire(self, state: tuple) -> tuple[tuple, list[list] | None]:
        raise NotImplementedError

    def fold_keys(
        self, states: list[tuple], sizes: np.ndarray, *columns: np.ndarray
    ) -> tuple[list[tuple], Sequence[int], list[Sequence]]:
        """``fold`` for some keys, whose events follow each other, ``sizes`` of them: their new states, and for the output lists
        put together, which key each place belongs to."""
        after, owner, out = [], [], [[] for _ in self.output_schema.split(", ")]
        ends = np.cumsum(sizes).tolist()
        for k, (state, begin, end) in enumerate(zip(states, [0, *ends], ends)):
            state, found = self.fold(state, *[c[begin:end] for c in columns])
            after.append(state)
            if found is not None:
                owner += [k] * len(found[0])
                for have, more in zip(out, found):
                    have += more
        return after, owner, out


class Bucket(StatefulProcessor):
    """Runs a rule for the keys of a bucket.

    Kept are the list of their states, each with its key; the watermark up to which events have been folded, so that one which
    comes later for a slot before it is late; the time the next timer is set to; and the events that wait, a list of Arrow batches.
    """

    def __init__(self, rule: Fold, key_type: str, events: pa.Schema, order: list[str], results: pa.Schema, slot_us: int):
        self.rule, self.events, self.order, self.results, self.slot_us = rule, events, order, results, slot_us
        fields = ", ".join(f.replace(" ", ":", 1) for f in rule.state_schema.split(", "))
        self.schema = f"held array<struct<key:{key_type}, {fields}>>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)
        self.clock = handle.getValueState("clock", "passed bigint, alarm bigint")
        self.waiting = handle.getListState("waiting", "data binary")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        held = {r[0]: tuple(r[1:]) for r in map(_values, initialState["held"])}
        deadlines = [d for d in map(self.rule.deadline, held.values()) if d is not None]
        self.state.update(([(name, *state) for name, state in held.items()],))
        self.clock.update((None, self._alarm(None, map(self._end, deadlines))))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        more = [(row["us"], (row["data"],)) for row in rows]
        self.waiting.appendList([data for _, data in more])
        passed, set_to = self.clock.get() or (None, None)
        alarm = self._alarm(set_to, [self._end(min(us for us, _ in more))])
        if alarm != set_to:
            self.clock.update((passed, alarm))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        passed, alarm = self.clock.get() or (None, None)
        if alarm is None or alarm >= timerValues.getCurrentWatermarkInMs():
            return  # this timer was set for what has been dealt with
        state = self.state.get()
        held = {r[0]: tuple(r[1:]) for r in map(_values, state[0])} if state else {}
        ends = []
        waiting = [pa.ipc.read_record_batch(pa.py_buffer(data), self.events) for (data,) in self.waiting.get()]
        if waiting:
            events = pa.Table.from_batches(waiting).combine_chunks()
            end = self._end(events["us"].to_numpy())
            closed = end <= upto
            if passed is not None:
                closed &= end > passed
            if closed.any():
                yield from self._fold(held, events.filter(pa.array(closed)))
            rest = end > upto
            if not rest.all():
                self.waiting.clear()
                if rest.any():
                    self.waiting.put([(b.serialize().to_pybytes(),) for b in events.filter(pa.array(rest)).to_batches()])
            if rest.any():
                ends.append(int(end[rest].min()))
        owner, out = [], [[] for _ in self.results.names[1:]]
        for name, one in list(held.items()):
            deadline = self.rule.deadline(one)
            if deadline is not None and self._end(deadline) <= upto:
                one, found = self.rule.expire(one)
                held[name] = one
                if one == self.rule.start:
                    del held[name]
                if found is not None:
                    owner += [name] * len(found[0])
                    for have, more in zip(out, found):
                        have += more
                deadline = self.rule.deadline(one)
            if deadline is not None:
                ends.append(self._end(deadline))
        yield from self._rows(owner, out)
        if held:
            self.state.update(([(name, *one) for name, one in held.items()],))
        elif state:
            self.state.clear()
        self.clock.update((upto, self._alarm(None, ends)))

    def _fold(self, held: dict, events: pa.Table) -> Iterator[Row]:
        """Folds closed events, all keys at once, into the states ``held``."""
        key = events["key"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, us = key.indices.to_numpy(), events["us"].to_numpy()
        at = np.lexsort((us, code))
        same = (code[at][1:] == code[at][:-1]) & (us[at][1:] == us[at][:-1])
        if self.order and same.any():
            ties = [pc.rank(events[c], null_placement="at_start", tiebreaker="dense").to_numpy() for c in self.order]
            at = np.lexsort((*ties[::-1], us, code))
        names = key.dictionary.to_pylist()
        columns = [_numpy(events[c])[at] for c in self.rule.columns]
        states = [held.pop(name, self.rule.start) for name in names]
        states, owner, out = self.rule.fold_keys(states, np.bincount(code, minlength=len(names)), *columns)
        held |= {name: state for name, state in zip(names, states) if state != self.rule.start}
        yield from self._rows(key.dictionary.take(pa.array(owner, pa.int64())), out)

    def _rows(self, keys, columns: list[Sequence]) -> Iterator[Row]:
        if len(keys):
            columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip([keys, *columns], self.results)]
            for batch in pa.Table.from_arrays(columns, schema=self.results).to_batches(ROW_VALUES):
                yield Row(data=batch.serialize().to_pybytes())

    def _alarm(self, alarm: int | None, ends) -> int | None:
        """The time (milliseconds) of the next timer, which is set if it comes before ``alarm``: right before the first end."""
        first = min((-(-end // 1000) - 1 for end in ends), default=None)
        if first is None or alarm is not None and alarm <= first:
            return alarm
        self.handle.registerTimer(first)
        return first

    def _end(self, us):
        """End of the slot that holds a time."""
        return (us // self.slot_us + 1) * self.slot_us

    def close(self) -> None:
        pass


def _numpy(column: pa.ChunkedArray) -> np.ndarray:
    if column.null_count:
        return np.array([*column.to_pylist(), None], object)[:-1]
    return column.to_numpy()


def _values(row) -> tuple:
    return tuple(row.values()) if isinstance(row, dict) else tuple(row)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, earliest time, events of the bucket as an Arrow batch) of batches with a bucket in front."""
    held: list[pa.RecordBatch] = []

    def pack() -> pa.RecordBatch:
        events = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        bucket = events["bucket"].to_numpy()
        order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
        begin = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        events = events.drop_columns("bucket").take(pa.array(order)).combine_chunks()
        first = np.minimum.reduceat(events["us"].to_numpy(), begin)
        (events,) = events.to_batches()
        size = np.diff(begin, append=len(order))
        data = [events.slice(a, n).serialize().to_pybytes() for a, n in zip(begin.tolist(), size.tolist())]
        return pa.record_batch([pa.array(bucket[order[begin]]), pa.array(first), pa.array(data, pa.binary())], PACKED.names)

    rows = size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= PACK_ROWS or size >= PACK_BYTES:
                yield pack()
                rows = size = 0
    if held:
        yield pack()


def folded(
    events: DataFrame,
    key: str,
    rule: Fold,
    slot_us: int,
    order: Sequence[str] = (),
    initial: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(key, output columns of the rule) of a fold over events: the key, ``us`` and the columns of the rule and of ``order``.

    Events of a key go by ``us`` and the columns ``order``. ``initial`` is a table with a row per key and the columns of the
    state, to start from.
    """
    key_type = events.schema[key].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    names = [f.split()[0] for f in rule.state_schema.split(", ")]
    started = None
    if initial is not None:
        state = F.collect_list(F.struct(F.col(key).alias("key"), *names)).alias("held")
        started = initial.select(bucket, key, *names).groupBy("bucket").agg(state).groupBy("bucket")
    columns = list(dict.fromkeys(["us", *rule.columns, *order]))
    events = events.where(F.col("us").isNotNull()).select(bucket, F.col(key).alias("key"), *columns)
    output = T.StructType.fromDDL(f"{key} {key_type}, {rule.output_schema}")
    results = to_arrow_schema(output)
    processor = Bucket(rule, key_type, to_arrow_schema(events.drop("bucket").schema), list(order), results, slot_us)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                yield pa.ipc.read_record_batch(data.as_buffer(), results)

    found = (
        events.mapInArrow(_packed, PACKED)
        .groupBy("bucket")
        .transformWithState(processor, "data binary", "Append", "EventTime", initialState=started)
    )
    return found.mapInArrow(unpack, output)


def timed(events: DataFrame, ts: str) -> DataFrame:
    """``events`` with their time in microseconds, ``us``; those without a time are dropped."""
    return events.where(F.col(ts).isNotNull()).withColumn("us", micros(ts))


def coded(kind: Column, codes: list[str]) -> Column:
    """The place of a text in ``codes``; null for others."""
    return F.when(kind.isin(*codes), F.array_position(F.array(*[F.lit(c) for c in codes]), kind).cast("int") - 1)


def decoded(code: Column, codes: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in codes]), code + 1)


def last_before(is_one: np.ndarray) -> np.ndarray:
    """For every place the last place up to it where ``is_one`` holds, else -1."""
    return np.maximum.accumulate(np.where(is_one, np.arange(len(is_one)), -1))


def ship_by_value(module: str) -> None:
    """Lets executors run the processors of a module without having the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_by_value(__name__)
