"""Silence detection as a stream.

Events are first reduced per key and time slot by a streaming aggregation, which combines map-side: a key that sends very
much costs its slots, not its events. Only the slots of a key pass through the stateful processor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import MICROS, micros, to_timestamp
from ..model import HEARTBEAT_MISSED_LIMIT, HEARTBEAT_TIMEOUT, JOIN_TIMEOUT
from .fold import BUCKETS, Fold, folded, ship_by_value


class SilenceAfterSlots(Fold):
    """Ends a key once nothing follows its last event for ``limit_us``, if that event was alarming.

    State: time of the last event, whether it is alarming, ended. The output has what a call adds: events in time, missed
    slot widths, the last event if the key ends, events after the end.
    """

    state_schema = "last_us bigint, alarming boolean, ended boolean"
    start = (None, False, False)
    columns = ["us", "last_us", "alarming", "n"]
    output_schema = "n bigint, missed bigint, last_us bigint, late bigint"

    def __init__(self, slot_us: int, limit_us: int):
        self.slot_us, self.limit_us = slot_us, limit_us

    def deadline(self, state):
        last_us, alarming, ended = state
        return last_us + self.limit_us if alarming and not ended else None

    def expire(self, state):
        return (state[0], state[1], True), [[0], [self.limit_us // self.slot_us], [state[0]], [0]]

    def fold(self, state, first_us, last_us, alarming, n):
        last, alarm, ended = state
        if ended:
            return state, [[0], [0], [None], [int(n.sum())]]
        begun = last is not None
        before = np.append(last if begun else first_us[0], last_us[:-1])
        gap = first_us - before
        over = (gap > self.limit_us) & np.append(alarm, alarming[:-1])
        over[0] &= begun
        end = int(np.argmax(over)) if over.any() else len(n)
        missed = np.minimum(np.maximum(gap[: end + 1], 0) // self.slot_us, self.limit_us // self.slot_us)
        found = [[int(n[:end].sum())], [int(missed.sum())], [None], [int(n[end:].sum())]]
        if end == len(n):
            return (int(last_us[-1]), bool(alarming[-1]), False), found
        found[2] = [int(before[end])]
        return (int(before[end]), True, True), found


ship_by_value(__name__)


def _silences(
    events: DataFrame, alarming: Column, slot_us: int, limit_us: int, buckets: int, initial: DataFrame | None = None
) -> DataFrame:
    """(key, n, missed, last_us, late): parts of sums, and the last event before the end of a key."""
    times = events.select("key", "ts", micros("ts").alias("us"), "event_id", alarming.alias("alarming"), "n")
    slots = (
        times.groupBy("key", F.window("ts", f"{slot_us} microseconds"))
        .agg(
            F.min("us").alias("us"),
            F.max(F.struct("us", "event_id", "alarming")).alias("last"),
            F.sum("n").alias("n"),
        )
        .select("key", "us", F.col("last.us").alias("last_us"), F.col("last.alarming").alias("alarming"), "n")
    )
    rule = SilenceAfterSlots(slot_us, limit_us)
    return folded(slots, "key", rule, slot_us, initial=initial, buckets=buckets)


def stream_heartbeat(
    beats: DataFrame,
    timeout: float = HEARTBEAT_TIMEOUT,
    missed_limit: int = HEARTBEAT_MISSED_LIMIT,
    starts: DataFrame | None = None,
    initial: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """What each micro-batch adds per key (key, beats, missed, terminated_at, late_beats); the sums are ``heartbeat_liveness``.

    ``beats`` is (key, ts) with a watermark on ``ts``. The clock of a key starts at its row in the stream ``starts`` (key, ts,
    with a watermark), so a key without any beat ends as well, or at its time in the table ``initial`` (key, ts), else at its
    first beat. ``terminated_at`` is set once, in the row that ends a key.
    """
    timeout_us = int(timeout * MICROS)
    limit_us = timeout_us * missed_limit
    rows = beats.select("key", "ts", F.lit(0).alias("event_id"), F.lit(1).cast("bigint").alias("n"))
    if starts is not None:
        rows = rows.unionByName(starts.select("key", "ts", F.lit(0).alias("event_id"), F.lit(0).cast("bigint").alias("n")))
    if initial is not None:
        initial = initial.groupBy("key").agg(F.max(micros("ts")).alias("last_us")).select(
            "key", "last_us", F.lit(True).alias("alarming"), F.lit(False).alias("ended")
        )
    found = _silences(rows, F.lit(True), timeout_us, limit_us, buckets, initial)
    return found.select(
        "key",
        F.col("n").alias("beats"),
        "missed",
        to_timestamp(F.col("last_us") + limit_us).alias("terminated_at"),
        F.col("late").alias("late_beats"),
    )


def stream_outage(coord_events: DataFrame, join_timeout: float = JOIN_TIMEOUT, buckets: int = BUCKETS) -> DataFrame:
    """Instances that end because the coordinator stayed away (key, down_at, terminated_at).

    ``coord_events`` is (key, ts, event_id, is_down) with a watermark on ``ts``.
    """
    deadline_us = 2 * int(join_timeout * MICROS)
    found = _silences(coord_events.withColumn("n", F.lit(1).cast("bigint")), F.col("is_down"), deadline_us, deadline_us, buckets)
    return found.where(F.col("last_us").isNotNull()).select(
        "key",
        to_timestamp(F.col("last_us")).alias("down_at"),
        to_timestamp(F.col("last_us") + deadline_us).alias("terminated_at"),
    )
