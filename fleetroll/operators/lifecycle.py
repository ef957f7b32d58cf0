"""State of instances over event time.

Events are rows (instance_id, ts, event_id, kind), ordered by (ts, event_id). Deadlines are exact: an event right on a
deadline still counts. Wherever a rule allows it the work is an aggregation over time slots, which combines map-side and
does not care how many rows a key has; the rest runs on ``Ordered``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import MICROS, as_of_micros, micros, slot_start, to_timestamp
from ..model import (
    ABSENT,
    AUTO_DOWN_POLL,
    BASE_KINDS,
    DEAD,
    DEPLOY_FAILED,
    DOWNED,
    ENDED,
    EXITING,
    HEARTBEAT_MISSED_LIMIT,
    HEARTBEAT_TIMEOUT,
    JOIN_TIMEOUT,
    LAUNCH_TIMEOUT,
    LAUNCHING,
    MEMBER_KINDS,
    REACHABLE,
    REJECTED,
    REMOVED,
    STORED,
    UNREACHABLE,
    UP,
    WAITING,
)
from ..plans import (
    DEFAULT_SKEW,
    Before,
    HotKeys,
    Next,
    Ordered,
    RunningMin,
    Scan,
    SkewPolicy,
    UpTo,
    find_hot_keys,
    skew_join,
)

_KEY = ["instance_id"]
_ORDER = ["us", "event_id"]


def _timed(events: DataFrame) -> DataFrame:
    """Events that can touch the registry, with integer time."""
    return events.where(~_is_exiting(events)).select("instance_id", micros("ts").alias("us"), "event_id", "kind").where(
        F.col("kind").isin(*BASE_KINDS, *MEMBER_KINDS)
    )


def _run_heads(rows: DataFrame, policy: SkewPolicy, **scans: Scan) -> Ordered:
    """Marks the base rows that start a run (``_head``) and adds the heads before (``_head_before``) and up to each row
    (``_open_head``); ``scans`` are further ones that need no heads.

    A run is a maximal series of LAUNCHING reports; any other base report is a run of its own. All frames look back, so
    all windows share one sort.
    """
    is_base = F.col("kind").isin(*BASE_KINDS)
    launching = F.col("kind") == LAUNCHING
    return (
        Ordered(rows, _KEY, _ORDER, policy)
        .scan(_was_launching=Before(F.when(is_base, launching)), **scans)
        .with_columns(
            _head=F.when(
                is_base & ~(launching & F.coalesce("_was_launching", F.lit(False))),
                F.struct("us", launching.alias("launching")),
            )
        )
        .scan(_head_before=Before(F.col("_head")), _open_head=UpTo(F.col("_head")))
    )


def _dead_by_next_head(timeout_us: int) -> Column:
    """Deadline of the launch that the row's run ends, if it was already over."""
    deadline = F.col("_head_before.us") + timeout_us
    return F.when(F.col("_head").isNotNull() & F.col("_head_before.launching") & (F.col("us") > deadline), deadline)


def _dead_at(timeout_us: int, as_of: Column) -> Column:
    """First missed launch deadline, from the aggregates of ``_launch_aggregates``."""
    open_deadline = F.col("_last_head.us") + timeout_us
    still_open = F.when(F.col("_last_head.launching") & (as_of > open_deadline), open_deadline)
    return F.least(F.col("_closed_dead"), still_open)


def _launch_aggregates(timeout_us: int) -> list[Column]:
    return [
        F.min(_dead_by_next_head(timeout_us)).alias("_closed_dead"),
        F.max_by("_head", F.when(F.col("_head").isNotNull(), F.struct("us", "event_id"))).alias("_last_head"),
    ]


def fleet_state(
    events: DataFrame,
    launch_timeout: float = LAUNCH_TIMEOUT,
    as_of: datetime | Column | None = None,
    clustered: bool = True,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Final state per instance (instance_id, state, dead_at).

    DEAD is final; ABSENT means deploy-failed or removed. One shuffle by instance: both windows and the aggregation share
    it. Without a cluster an UP instance leaves the registry and is STORED.
    """
    timeout_us = int(launch_timeout * MICROS)
    rows = _run_heads(_timed(events), policy).df

    def last(kinds: Column) -> Column:
        return F.max(F.when(kinds, F.struct("us", "event_id", "kind")))

    per_instance = rows.groupBy("instance_id").agg(
        *_launch_aggregates(timeout_us),
        last(F.col("kind").isin(*BASE_KINDS)).alias("base"),
        last(F.col("kind") == REMOVED).alias("removed"),
        last(F.col("kind").isin(UNREACHABLE, REACHABLE)).alias("reach"),
    )
    up = UP if clustered else STORED
    state = (
        F.when(F.col("dead_us").isNotNull(), DEAD)
        .when(F.col("base.kind") == DEPLOY_FAILED, ABSENT)
        .when(F.col("base.kind") != UP, F.col("base.kind"))
        .when(F.lit(not clustered), up)
        .when(F.col("removed") > F.col("base"), ABSENT)
        .when((F.col("reach") > F.col("base")) & (F.col("reach.kind") == UNREACHABLE), UNREACHABLE)
        .otherwise(up)
    )
    return (
        per_instance.where(F.col("base").isNotNull())
        .withColumn("dead_us", _dead_at(timeout_us, as_of_micros(events, as_of)))
        .select("instance_id", state.alias("state"), to_timestamp(F.col("dead_us")).alias("dead_at"))
    )


def launch_timeouts(
    events: DataFrame,
    launch_timeout: float = LAUNCH_TIMEOUT,
    as_of: datetime | Column | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Instances declared dead (instance_id, dead_at)."""
    timeout_us = int(launch_timeout * MICROS)
    base = _timed(events).where(F.col("kind").isin(*BASE_KINDS))
    dead = (
        _run_heads(base, policy)
        .df.groupBy("instance_id")
        .agg(*_launch_aggregates(timeout_us))
        .select("instance_id", _dead_at(timeout_us, as_of_micros(events, as_of)).alias("dead_us"))
    )
    return dead.where(F.col("dead_us").isNotNull()).select("instance_id", to_timestamp(F.col("dead_us")).alias("dead_at"))


def _with_deaths(events: DataFrame, launch_timeout: float, policy: SkewPolicy, **scans: Scan) -> Ordered:
    """Adds to every event the first launch deadline it shows to be missed (``dead_us``), and whether an earlier event
    shows one as well (``_missed_before``).

    An event after a missed deadline either ends the launching run or still belongs to it, so looking back is enough and
    no event is joined with its instance's death.
    """
    timeout_us = int(launch_timeout * MICROS)
    deadline = F.col("_open_head.us") + timeout_us
    still_launching = F.when(F.col("_open_head.launching") & (F.col("us") > deadline), deadline)
    return (
        _run_heads(_timed(events), policy, **scans)
        .with_columns(_missed=F.coalesce(_dead_by_next_head(timeout_us), still_launching))
        .scan(dead_us=RunningMin(F.col("_missed")), _missed_before=Before(F.col("_missed")))
    )


def rejected_updates(
    events: DataFrame, launch_timeout: float = LAUNCH_TIMEOUT, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Events of dead instances after their death (instance_id, event_id, ts, kind, dead_at)."""
    late = _with_deaths(events, launch_timeout, policy).df.where(F.col("dead_us").isNotNull())
    return late.select(
        "instance_id",
        "event_id",
        to_timestamp(F.col("us")).alias("ts"),
        "kind",
        to_timestamp(F.col("dead_us")).alias("dead_at"),
    )


def fleet_transitions(
    events: DataFrame,
    launch_timeout: float = LAUNCH_TIMEOUT,
    as_of: datetime | Column | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
    clustered: bool = True,
) -> DataFrame:
    """The state after every event (instance_id, ts, event_id, state), REJECTED ones and one DEAD row per death included.

    Member events before the first report of an instance have no effect and no row. Without a cluster an instance that is UP
    leaves the local registry and is STORED: member events do not meet it until its next report brings it back. All windows
    share one shuffle.
    """
    kind = F.col("kind")
    at = F.struct("us", "event_id", "kind")
    seen = _with_deaths(
        events,
        launch_timeout,
        policy,
        base=UpTo(F.when(kind.isin(*BASE_KINDS), at)),
        removed=UpTo(F.when(kind == REMOVED, at)),
        reach=UpTo(F.when(kind.isin(UNREACHABLE, REACHABLE), at)),
        _next=Next(F.lit(True)),
    )
    state = (
        F.when(F.col("dead_us").isNotNull(), REJECTED)
        .when(F.col("base.kind") == DEPLOY_FAILED, ABSENT)
        .when(F.col("base.kind") != UP, F.col("base.kind"))
        .when(F.lit(not clustered), STORED)
        .when(F.col("removed") > F.col("base"), ABSENT)
        .when((F.col("reach") > F.col("base")) & (F.col("reach.kind") == UNREACHABLE), UNREACHABLE)
        .otherwise(UP)
    )
    # A death shows at the first event after it, or after the last event of an instance that is still launching.
    deadline = F.col("_open_head.us") + int(launch_timeout * MICROS)
    overdue = F.col("_next").isNull() & F.col("_open_head.launching") & (as_of_micros(events, as_of) > deadline)
    death = (
        F.when(F.col("dead_us").isNotNull(), F.when(F.col("_missed_before").isNull(), F.col("dead_us")))
        .when(overdue, deadline)
    )
    step = F.struct(F.col("us"), F.col("event_id"), state.alias("state"))
    end = F.struct(death.alias("us"), F.lit(None).cast("bigint").alias("event_id"), F.lit(DEAD).alias("state"))
    rows = seen.where(F.col("base").isNotNull()).df.select("instance_id", F.inline(F.array(step, end)))
    return rows.where(F.col("us").isNotNull()).select(
        "instance_id", to_timestamp(F.col("us")).alias("ts"), "event_id", "state"
    )


def fleet_carry(
    events: DataFrame, launch_timeout: float = LAUNCH_TIMEOUT, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """What later events of an instance need to know of ``events``: one row per instance, to start a stream from.

    (instance_id, base, deadline, dead, removed, away): the last report, the deadline of a launch that is still open, and
    whether the instance is dead, removed or unreachable since that report. Only events show a death here; a launch whose
    deadline has passed without one stays open, for the stream to end it.
    """

    def last(kinds: Column) -> Column:
        return F.max(F.when(kinds, F.struct("us", "event_id", "kind")))

    per_instance = _with_deaths(events, launch_timeout, policy).df.groupBy("instance_id").agg(
        last(F.col("kind").isin(*BASE_KINDS)).alias("base"),
        last(F.col("kind") == REMOVED).alias("removed"),
        last(F.col("kind").isin(UNREACHABLE, REACHABLE)).alias("reach"),
        F.min("dead_us").alias("dead_us"),
        F.max_by("_head", F.when(F.col("_head").isNotNull(), F.struct("us", "event_id"))).alias("head"),
    )
    dead = F.col("dead_us").isNotNull()
    still_open = F.when(~dead & F.col("head.launching"), F.col("head.us") + int(launch_timeout * MICROS))
    away = (F.col("reach") > F.col("base")) & (F.col("reach.kind") == UNREACHABLE)
    return per_instance.where(F.col("base").isNotNull()).select(
        "instance_id",
        F.col("base.kind").alias("base"),
        still_open.alias("deadline"),
        dead.alias("dead"),
        F.coalesce(F.col("removed") > F.col("base"), F.lit(False)).alias("removed"),
        F.coalesce(away, F.lit(False)).alias("away"),
    )


def heartbeat_liveness(
    beats: DataFrame,
    timeout: float = HEARTBEAT_TIMEOUT,
    missed_limit: int = HEARTBEAT_MISSED_LIMIT,
    as_of: datetime | Column | None = None,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Per key of (key, ts): beats in time, missed beats, end time if silent for too long, beats after the end.

    The clock of a key starts at its row in ``starts`` (key, ts), else at its first beat. Beats are first reduced to one
    row per key and timeout-wide slot: within a slot nothing can be missed, so only gaps between slots matter.
    """
    timeout_us = int(timeout * MICROS)
    limit_us = timeout_us * missed_limit
    rows = beats.select("key", micros("ts").alias("us"), F.lit(1).alias("n"))
    if starts is not None:
        rows = rows.union(starts.select("key", micros("ts"), F.lit(0)))
    slots = rows.groupBy("key", slot_start(F.col("us"), timeout_us).alias("slot")).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("n").alias("n")
    )
    in_order = Window.partitionBy("key").orderBy("slot")
    gap = F.coalesce(F.lead("first_us").over(in_order), as_of_micros(beats, as_of)) - F.col("last_us")
    gaps = slots.withColumn("gap", gap).withColumn(
        "end_us", F.when(F.col("gap") > limit_us, F.col("last_us") + limit_us)
    )
    ended = F.min("end_us").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    missed = F.least(F.expr(f"greatest(gap, 0) div {timeout_us}"), F.lit(missed_limit))
    alive = F.col("ended_before").isNull()
    per_key = (
        gaps.withColumn("ended_before", ended)
        .groupBy("key")
        .agg(
            F.sum(F.when(alive, F.col("n")).otherwise(0)).alias("beats"),
            F.sum(F.when(alive, missed).otherwise(0)).alias("missed"),
            F.min("end_us").alias("end_us"),
            F.sum(F.when(alive, 0).otherwise(F.col("n"))).alias("late_beats"),
        )
    )
    return per_key.select("key", "beats", "missed", to_timestamp(F.col("end_us")).alias("terminated_at"), "late_beats")


def outage_terminations(
    coord_events: DataFrame, join_timeout: float = JOIN_TIMEOUT, as_of: datetime | Column | None = None
) -> DataFrame:
    """Instances that end because the coordinator stayed away (key, down_at, terminated_at).

    Events are (key, ts, event_id, is_down). A down that no coordinator event follows within twice the join timeout ends
    the instance. As with heartbeats only the last event of a deadline-wide slot can start such a gap.
    """
    deadline_us = 2 * int(join_timeout * MICROS)
    slots = (
        coord_events.select("key", micros("ts").alias("us"), "event_id", "is_down")
        .groupBy("key", slot_start(F.col("us"), deadline_us).alias("slot"))
        .agg(F.min("us").alias("first_us"), F.max(F.struct("us", "event_id", "is_down")).alias("last"))
    )
    following = F.coalesce(
        F.lead("first_us").over(Window.partitionBy("key").orderBy("slot")), as_of_micros(coord_events, as_of)
    )
    lost = slots.withColumn("following", following).where(
        F.col("last.is_down") & (F.col("following") - F.col("last.us") > deadline_us)
    )
    first = lost.groupBy("key").agg(F.min("last.us").alias("us"))
    return first.select(
        "key", to_timestamp(F.col("us")).alias("down_at"), to_timestamp(F.col("us") + deadline_us).alias("terminated_at")
    )


def registration_attempts(log: DataFrame, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Per key of (key, ts, event_id, ok): attempts up to the first success and its time, null while open."""
    rows = log.select("key", micros("ts").alias("us"), "event_id", "ok")
    tried = Ordered(rows, ["key"], _ORDER, policy).scan(_done=Before(F.when(F.col("ok"), F.lit(True))))
    per_key = (
        tried.where(F.col("_done").isNull())
        .df.groupBy("key")
        .agg(F.count(F.lit(1)).alias("attempts"), F.min(F.when(F.col("ok"), F.col("us"))).alias("us"))
    )
    return per_key.select("key", "attempts", to_timestamp(F.col("us")).alias("registered_at"))


def match_members(events: DataFrame, reg: DataFrame, policy: SkewPolicy = DEFAULT_SKEW) -> tuple[DataFrame, DataFrame]:
    """(matched, unknown) member events by unique address; the smallest id wins when several instances share one."""
    by_address = (
        reg.where(F.col("info.address").isNotNull())
        .groupBy(F.col("info.address").alias("address"))
        .agg(F.min("instance_id").alias("instance_id"))
    )
    joined = skew_join(events, by_address, ["address"], "left", policy)
    return (
        joined.where(F.col("instance_id").isNotNull()),
        joined.where(F.col("instance_id").isNull()).drop("instance_id"),
    )


def _is_exiting(events: DataFrame) -> Column:
    """An exiting member that gets unreachable, which is expected; false where ``events`` have no such column."""
    if "exiting" not in events.columns:
        return F.lit(False)
    return (F.col("kind") == UNREACHABLE) & F.coalesce("exiting", F.lit(False))


def unreachable_episodes(
    events: DataFrame, policy: SkewPolicy = DEFAULT_SKEW, hot: HotKeys | None = None
) -> DataFrame:
    """Episodes (instance_id, start_us, end_us) from member events; an open episode has no end, exiting members have none."""
    rows = events.where(F.col("kind").isin(*MEMBER_KINDS) & ~_is_exiting(events)).select(
        "instance_id", micros("ts").alias("us"), "event_id", (F.col("kind") == UNREACHABLE).alias("away")
    )
    changes = (
        Ordered(rows, _KEY, _ORDER, policy, hot)
        .scan(_was_away=Before(F.col("away")))
        .where(F.col("away") != F.coalesce("_was_away", F.lit(False)))
        .scan(end_us=Next(F.col("us")))
        .where(F.col("away"))
    )
    return changes.df.select("instance_id", F.col("us").alias("start_us"), "end_us")


def auto_down(
    events: DataFrame, deregistered: DataFrame, poll: float = AUTO_DOWN_POLL, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Per unreachable episode (instance_id, unreachable_at, ended_at, down_at, outcome) the poll that downs the member, if any.

    ``deregistered`` is (instance_id, deregistered_at): null is still registered, no row never was. Polls come at once and
    then every ``poll`` seconds; the first one at or after deregistration downs the member if the episode still lasts: it is
    DOWNED, else ENDED or still WAITING. A member that is ``exiting`` (a column of ``events``) when it gets unreachable is
    downed at once: EXITING, a row for each such event, without an episode or a poll.
    """
    poll_us = int(poll * MICROS)
    gone = deregistered.select("instance_id", micros("deregistered_at").alias("gone_us"), F.lit(True).alias("_listed"))
    hot = find_hot_keys(events, _KEY, policy)  # only these can have many episodes
    joined = skew_join(unreachable_episodes(events, policy, hot), gone, _KEY, "left", policy, hot)
    waited = F.greatest(F.lit(0), F.col("gone_us") - F.col("start_us"))
    first_poll = F.col("start_us") + waited + F.pmod(-waited, F.lit(poll_us))  # waited, rounded up to whole polls
    at = F.when(F.col("_listed").isNull(), F.col("start_us")).when(F.col("gone_us").isNotNull(), first_poll)
    in_time = F.col("end_us").isNull() | (F.col("_at") < F.col("end_us"))
    outcome = F.when(F.col("_down").isNotNull(), DOWNED).when(F.col("end_us").isNotNull(), ENDED).otherwise(WAITING)
    polled = joined.withColumn("_at", at).withColumn("_down", F.when(in_time, F.col("_at"))).select(
        "instance_id",
        to_timestamp(F.col("start_us")).alias("unreachable_at"),
        to_timestamp(F.col("end_us")).alias("ended_at"),
        to_timestamp(F.col("_down")).alias("down_at"),
        outcome.alias("outcome"),
    )
    if "exiting" not in events.columns:
        return polled
    at_once = to_timestamp(micros("ts"))
    left = events.where(_is_exiting(events)).select(
        "instance_id",
        at_once.alias("unreachable_at"),
        F.lit(None).cast("timestamp").alias("ended_at"),
        at_once.alias("down_at"),
        F.lit(EXITING).alias("outcome"),
    )
    return polled.unionByName(left)


def auto_down_carry(events: DataFrame, deregistered: DataFrame, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """What a stream needs to go on with: (instance_id, since, gone, done) of members that are away or deregistered.

    The open episodes of ``events`` are the stream's to end; those that are over are in ``auto_down`` with ``ended_at``.
    """
    away = unreachable_episodes(events, policy).where(F.col("end_us").isNull())
    gone = deregistered.where(F.col("deregistered_at").isNotNull())
    sides = away.select("instance_id", F.col("start_us").alias("since"), F.lit(None).cast("bigint").alias("gone")).unionByName(
        gone.select("instance_id", F.lit(None).cast("bigint").alias("since"), micros("deregistered_at").alias("gone"))
    )
    return sides.groupBy("instance_id").agg(
        F.min("since").alias("since"), F.min("gone").alias("gone"), F.lit(False).alias("done")
    )
