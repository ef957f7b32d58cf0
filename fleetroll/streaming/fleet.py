"""Instance states as a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import MICROS, to_timestamp
from ..model import (
    ABSENT,
    BASE_KINDS,
    DEAD,
    DEPLOY_FAILED,
    LAUNCH_TIMEOUT,
    LAUNCHING,
    REACHABLE,
    REJECTED,
    REMOVED,
    STORED,
    UNREACHABLE,
    UP,
)
from .fold import BUCKETS, SLOT, Fold, coded, decoded, folded, last_before, ship_by_value, timed

CODES = [*BASE_KINDS, UNREACHABLE, REACHABLE, REMOVED, ABSENT, STORED, DEAD, REJECTED]
_CODE = {name: code for code, name in enumerate(CODES)}


class FleetState(Fold):
    """State: last base kind, launch deadline, dead, removed since the base event, unreachable since the base event."""

    state_schema = "base string, deadline bigint, dead boolean, removed boolean, away boolean"
    start = (None, None, False, False, False)
    columns = ["us", "event_id", "code"]
    output_schema = "us bigint, event_id bigint, code int"

    def __init__(self, timeout_us: int, clustered: bool):
        self.timeout_us, self.clustered = timeout_us, clustered

    def deadline(self, state):
        return state[1]

    def expire(self, state):
        base, deadline, _, removed, away = state
        return (base, None, True, removed, away), [[deadline], [None], [_CODE[DEAD]]]

    def fold(self, state, us, event_id, code):
        base, deadline, dead, removed, away = state
        rejected, up = _CODE[REJECTED], _CODE[UP]
        if dead:
            return state, [us.tolist(), event_id.tolist(), [rejected] * len(us)]
        is_base = code < len(BASE_KINDS)
        launching = code == _CODE[LAUNCHING]
        at = last_before(is_base)  # the report in force, -1 for the carried one
        before = np.append(-1, at[:-1])
        carried = -1 if base is None else _CODE[base]
        kind = np.where(at >= 0, code[at], carried)
        kind_before = np.where(before >= 0, code[before], carried)
        # A run of launching reports is due from its first one.
        head = last_before(is_base & ~(launching & (kind_before == _CODE[LAUNCHING])))
        none = np.iinfo(np.int64).max
        first_due = none if deadline is None else deadline
        due = np.where(kind == _CODE[LAUNCHING], np.where(head >= 0, us[head] + self.timeout_us, first_due), none)
        late = us > np.append(first_due, due[:-1])
        alive = int(np.argmax(late)) if late.any() else len(us)

        gone_at, reach_at = last_before(code == _CODE[REMOVED]), last_before((code == _CODE[UNREACHABLE]) | (code == _CODE[REACHABLE]))
        kept = at < 0  # what was carried still holds
        is_gone = (gone_at > at) | (kept & removed)
        is_away = np.where(reach_at > at, code[reach_at] == _CODE[UNREACHABLE], kept & away)
        if self.clustered:
            shown = np.where((kind == up) & is_gone, _CODE[ABSENT], np.where((kind == up) & is_away, _CODE[UNREACHABLE], kind))
        else:
            shown = np.where(kind == up, _CODE[STORED], kind)
        shown = np.where(kind == _CODE[DEPLOY_FAILED], _CODE[ABSENT], shown)

        told = np.flatnonzero(kind[:alive] >= 0)
        out = [us[told].tolist(), event_id[told].tolist(), shown[told].tolist()]
        if alive < len(us):
            end = int(first_due if alive == 0 else due[alive - 1])
            out[0] += [end, *us[alive:].tolist()]
            out[1] += [None, *event_id[alive:].tolist()]
            out[2] += [_CODE[DEAD], *[rejected] * (len(us) - alive)]
        if alive:
            i = alive - 1
            if kind[i] >= 0:
                deadline = None if due[i] == none else int(due[i])
                state = (CODES[kind[i]], deadline, False, bool(is_gone[i]), bool(is_away[i]))
        if alive < len(us):
            state = (state[0], None, True, *state[3:])
        return state, out if out[0] else None


ship_by_value(__name__)


def stream_fleet_state(
    updates: DataFrame,
    launch_timeout: float = LAUNCH_TIMEOUT,
    clustered: bool = True,
    initial: DataFrame | None = None,
    slot: float = SLOT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The state after every event, with DEAD and REJECTED rows: the streaming form of ``fleet_transitions``.

    ``updates`` has (instance_id, ts, event_id, kind) and a watermark on ``ts``, optionally ``exiting``. Input of several kinds
    (reports, member events already matched to instances) is one unioned stream. ``initial`` are states to start from, as
    ``fleet_carry`` gives them for the events before the stream. Results come when their ``slot`` (seconds) is over.
    """
    slot_us = int(slot * MICROS)
    kinds = F.col("kind").isin(*BASE_KINDS, UNREACHABLE, REACHABLE, REMOVED)
    if "exiting" in updates.columns:
        # An exiting member is expected to become unreachable.
        kinds = kinds & ~((F.col("kind") == UNREACHABLE) & F.coalesce("exiting", F.lit(False)))
    rows = updates.where(kinds).select("instance_id", "ts", "event_id", coded(F.col("kind"), CODES).alias("code"))
    rule = FleetState(int(launch_timeout * MICROS), clustered)
    steps = folded(timed(rows, "ts"), "instance_id", rule, slot_us, ["event_id", "code"], initial, buckets)
    return steps.select("instance_id", to_timestamp(F.col("us")).alias("ts"), "event_id", decoded(F.col("code"), CODES).alias("state"))
