"""Downing of unreachable members as a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import MICROS, to_timestamp
from ..model import AUTO_DOWN_POLL, DOWNED, EXITING, MEMBER_KINDS, UNREACHABLE
from .fold import BUCKETS, SLOT, Fold, coded, folded, ship_by_value, timed

DEREGISTERED = "DEREGISTERED"
CODES = [DEREGISTERED, *MEMBER_KINDS]


class AutoDown(Fold):
    """State: start of the open episode, time of deregistration, whether the episode is done with."""

    state_schema = "since bigint, gone bigint, done boolean"
    start = (None, None, False)
    columns = ["us", "code"]
    output_schema = "since_us bigint, down_us bigint"

    def __init__(self, poll_us: int):
        self.poll_us = poll_us

    def deadline(self, state):
        since, gone, done = state
        return None if since is None or gone is None or done else int(self._poll(np.int64(since), gone))

    def expire(self, state):
        since, gone, _ = state
        return (since, gone, True), [[since], [self.deadline(state)]]

    def fold(self, state, us, code):
        since, gone, done = state
        listed = us[code == CODES.index(DEREGISTERED)]
        if gone is None and len(listed):
            gone = int(listed[0])
        member = code != CODES.index(DEREGISTERED)
        at, away = us[member], code[member] == CODES.index(UNREACHABLE)
        was_away = np.append(since is not None, away)[: len(away)]
        starts, ends = at[away & ~was_away], at[~away & was_away]
        if since is not None:
            starts = np.append(since, starts)
        open_since = int(starts[-1]) if len(starts) > len(ends) else None
        out = None
        if gone is not None:
            closed = starts[: len(ends)]
            polls = self._poll(closed, gone)
            downed = polls < ends
            if since is not None and done and len(ends):
                downed[0] = False
            if downed.any():
                out = [closed[downed].tolist(), polls[downed].tolist()]
        return (open_since, gone, bool(done and open_since is not None and open_since == since and not len(ends))), out

    def _poll(self, since: np.ndarray, gone: int) -> np.ndarray:
        return since + -(-np.maximum(0, gone - since) // self.poll_us) * self.poll_us


ship_by_value(__name__)


def stream_auto_down(
    events: DataFrame,
    deregistered: DataFrame,
    poll: float = AUTO_DOWN_POLL,
    initial: DataFrame | None = None,
    slot: float = SLOT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Downed members (instance_id, unreachable_at, down_at, outcome).

    Both streams have a watermark on their time, ``ts`` and ``deregistered_at``. An instance counts as registered until
    its row in ``deregistered`` comes; one that never was has a row with an early time. A member that is ``exiting`` (a
    column of ``events``) when it gets unreachable is downed at once, without state. ``initial`` are episodes to start from
    (instance_id, since, gone, done), as ``auto_down_carry`` gives them.
    """
    slot_us = int(slot * MICROS)
    exiting = F.lit(False)
    if "exiting" in events.columns:
        exiting = (F.col("kind") == UNREACHABLE) & F.coalesce("exiting", F.lit(False))
    member = events.where(F.col("kind").isin(*MEMBER_KINDS) & ~exiting).select("instance_id", "ts", "event_id", "kind")
    gone = deregistered.select(
        "instance_id",
        F.col("deregistered_at").alias("ts"),
        F.lit(-1).cast("bigint").alias("event_id"),
        F.lit(DEREGISTERED).alias("kind"),
    )
    rows = member.unionByName(gone).withColumn("code", coded(F.col("kind"), CODES))
    rule = AutoDown(int(poll * MICROS))
    downs = folded(timed(rows, "ts"), "instance_id", rule, slot_us, ["event_id", "code"], initial, buckets)
    polled = downs.select(
        "instance_id",
        to_timestamp(F.col("since_us")).alias("unreachable_at"),
        to_timestamp(F.col("down_us")).alias("down_at"),
        F.lit(DOWNED).alias("outcome"),
    )
    if "exiting" not in events.columns:
        return polled
    left = events.where(exiting).select(
        "instance_id", F.col("ts").alias("unreachable_at"), F.col("ts").alias("down_at"), F.lit(EXITING).alias("outcome")
    )
    return polled.unionByName(left)
