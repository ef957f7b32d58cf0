import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetroll import operators as ops
from fleetroll.plans import DEFAULT_SKEW, SkewPolicy
from tests import folds
from tests.helpers import SPLIT, seconds, table

EVENTS = "instance_id string, ts double, event_id bigint, kind string"
KINDS = ["DEPLOYING", "LAUNCHING", "LAUNCHING", "UP", "UP", "DEPLOY_FAILED", "UNREACHABLE", "REACHABLE", "REMOVED"]
POLICIES = pytest.mark.parametrize("policy", [DEFAULT_SKEW, SPLIT, SkewPolicy(group_rows=40, probe_bytes=0)])


def at(spark, t):
    return F.timestamp_micros(F.lit(int(t * 1_000_000)))


def random_events(seed, keys, kinds, hot=0, span=30):
    """Integer times with many ties; key k0 gets ``hot`` further rows."""
    rng = random.Random(seed)
    rows, event_id = [], 0
    for k in range(keys):
        for _ in range(rng.randint(1, 14) + (hot if k == 0 else 0)):
            event_id += 1
            rows.append((f"k{k}", float(rng.randint(0, span)), rng.randint(0, 3) * 100_000 + event_id, rng.choice(kinds)))
    rng.shuffle(rows)
    return rows


def by_key(rows):
    groups = defaultdict(list)
    for key, *rest in rows:
        groups[key].append(tuple(rest))
    return groups


def states(spark, rows, timeout, as_of, **kw):
    df = ops.fleet_state(table(spark, rows, EVENTS, "ts"), timeout, at(spark, as_of), **kw)
    return {r[0]: (r[1], r[2]) for r in seconds(df)}


def test_unreachable_reachable_removed(spark):
    rows = [("a", 0.0, 1, "UP"), ("a", 1.0, 2, "UNREACHABLE")]
    assert states(spark, rows, 2, 100) == {"a": ("UNREACHABLE", None)}
    rows.append(("a", 2.0, 3, "REACHABLE"))
    assert states(spark, rows, 2, 100) == {"a": ("UP", None)}
    rows.append(("a", 3.0, 4, "REMOVED"))
    assert states(spark, rows, 2, 100) == {"a": ("ABSENT", None)}
    assert states(spark, rows, 2, 100, clustered=False) == {"a": ("STORED", None)}


def test_deploy_failed_is_not_final(spark):
    rows = [("a", 0.0, 1, "DEPLOYING"), ("a", 1.0, 2, "DEPLOY_FAILED")]
    assert states(spark, rows, 2, 100) == {"a": ("ABSENT", None)}
    assert states(spark, [*rows, ("a", 9.0, 3, "UP")], 2, 100) == {"a": ("UP", None)}


def test_launch_timeout(spark):
    rows = [("a", 0.0, 1, "LAUNCHING"), ("b", 0.0, 2, "LAUNCHING"), ("b", 1.0, 3, "UP"), ("c", 0.0, 4, "DEPLOYING")]
    rows += [("d", 0.0, 5, "LAUNCHING"), ("d", 2.0, 6, "UP"), ("a", 5.0, 7, "UP")]
    events = table(spark, rows, EVENTS, "ts")
    assert states(spark, rows, 2, 100) == {"a": ("DEAD", 2.0), "b": ("UP", None), "c": ("DEPLOYING", None), "d": ("UP", None)}
    assert seconds(ops.launch_timeouts(events, 2, at(spark, 100))) == [("a", 2.0)]
    assert seconds(ops.rejected_updates(events, 2)) == [("a", 7, 5.0, "UP", 2.0)]
    assert seconds(ops.launch_timeouts(table(spark, rows[:1], EVENTS, "ts"), 2, at(spark, 2))) == []


def test_exiting_members_do_not_become_unreachable(spark):
    rows = [("a", 0.0, 1, "UP", None), ("a", 1.0, 2, "UNREACHABLE", True), ("b", 0.0, 3, "UP", None), ("b", 1.0, 4, "UNREACHABLE", False)]
    events = table(spark, rows, EVENTS + ", exiting boolean", "ts")
    assert {r[0]: r[1] for r in seconds(ops.fleet_state(events, 2))} == {"a": "UP", "b": "UNREACHABLE"}


@POLICIES
@pytest.mark.parametrize("seed", [1, 2])
def test_fleet_against_fold(spark, policy, seed):
    rows = random_events(seed, 300, KINDS, hot=200, span=40)
    timeout, as_of = 3, 41
    events = table(spark, rows, EVENTS, "ts")
    want = {k: folds.fleet(e, timeout, as_of) for k, e in by_key(rows).items()}
    got = {r[0]: (r[1], r[2]) for r in seconds(ops.fleet_state(events, timeout, at(spark, as_of), policy=policy))}
    assert got == {k: (state, dead) for k, (_, state, dead) in want.items() if state is not None}
    steps = seconds(ops.fleet_transitions(events, timeout, at(spark, as_of), policy))
    assert steps == sorted(((k, *s) for k, (ss, _, _) in want.items() for s in ss), key=str)


@pytest.mark.parametrize("starts", [False, True])
def test_heartbeat_against_timer(spark, starts):
    rng = random.Random(5)
    beats = {f"k{k}": [rng.randint(0, 60) / 2 for _ in range(rng.randint(1, 12))] for k in range(400)}
    beats["k0"] += [rng.randint(0, 20) / 2 for _ in range(500)]
    begin = {k: min(b) - rng.randint(0, 8) / 2 for k, b in beats.items()}
    df = table(spark, [(k, t) for k, ts in beats.items() for t in ts], "key string, ts double", "ts")
    first = table(spark, list(begin.items()), "key string, ts double", "ts") if starts else None
    got = {r[0]: r[1:] for r in seconds(ops.heartbeat_liveness(df, 1.5, 2, at(spark, 32), first).select("key", "beats", "missed", "terminated_at", "late_beats"))}
    for k, b in beats.items():
        assert got[k] == folds.heartbeat(b, 1.5, 2, 32, begin[k] if starts else None), (k, sorted(b))


def test_heartbeat_cases(spark):
    def run(times, as_of):
        df = table(spark, [("m", t) for t in times], "key string, ts double", "ts")
        return seconds(ops.heartbeat_liveness(df, 1.2, 2, at(spark, as_of)).select("terminated_at"))[0][0]

    assert run([0.0], 10) == pytest.approx(2.4)
    assert run([0.0, 1.0, 2.0, 3.0, 4.0], 4.5) is None
    assert run([0.0, 2.0, 4.0], 5) is None  # one miss is tolerated


def test_outage_against_fold(spark):
    rng = random.Random(6)
    rows = [(f"k{k}", float(rng.randint(0, 40)), i * 1000 + k, rng.random() < 0.6) for k in range(400) for i in range(rng.randint(1, 9))]
    df = table(spark, rows, "key string, ts double, event_id bigint, is_down boolean", "ts")
    got = {r[0]: r[1] for r in seconds(ops.outage_terminations(df, 2, at(spark, 42)).select("key", "down_at"))}
    want = {k: folds.outage(e, 4, 42) for k, e in by_key(rows).items()}
    assert got == {k: t for k, t in want.items() if t is not None}


@POLICIES
def test_auto_down_against_polls(spark, policy):
    rows = random_events(7, 300, ["UNREACHABLE", "REACHABLE", "REMOVED", "UP"], hot=150)
    rng = random.Random(8)
    gone = {f"k{k}": rng.choice([None, "never", rng.randint(-5, 35) / 2]) for k in range(300)}
    events = table(spark, rows, EVENTS, "ts")
    listed = table(spark, [(k, d) for k, d in gone.items() if d != "never"], "instance_id string, deregistered_at double", "deregistered_at")
    got = seconds(ops.auto_down(events, listed, 1.5, policy).drop("outcome"))
    members = by_key([r for r in rows if r[3] != "UP"])
    want = [(k, *e) for k, ev in members.items() for e in folds.auto_down(ev, gone[k], 1.5)]
    assert got == sorted(want, key=str)


def test_exiting_members_are_downed_at_once(spark):
    rows = [("a", 0.0, 1, "UNREACHABLE", True), ("b", 0.0, 2, "UNREACHABLE", False), ("b", 1.0, 3, "UNREACHABLE", True), ("c", 5.0, 4, "UNREACHABLE", None)]
    rows += [("c", 7.0, 5, "REACHABLE", None)]
    events = table(spark, rows, EVENTS + ", exiting boolean", "ts")
    listed = table(spark, [("a", 40.0), ("b", 40.0), ("c", 40.0)], "instance_id string, deregistered_at double", "deregistered_at")
    assert seconds(ops.auto_down(events, listed, 30)) == [
        ("a", 0.0, None, 0.0, "EXITING"),
        ("b", 0.0, None, 60.0, "DOWNED"),
        ("b", 1.0, None, 1.0, "EXITING"),
        ("c", 5.0, 7.0, None, "ENDED"),
    ]


def test_unclustered_instances_leave_the_local_registry(spark):
    """Member events do not meet an instance that is UP; its next report brings it back."""
    rows = [("a", 0.0, 1, "LAUNCHING"), ("a", 1.0, 2, "UP"), ("a", 2.0, 3, "UNREACHABLE"), ("a", 3.0, 4, "REMOVED"), ("a", 4.0, 5, "LAUNCHING")]
    rows += [("a", 5.0, 6, "DEPLOY_FAILED"), ("b", 0.0, 7, "LAUNCHING"), ("b", 9.0, 8, "UP")]
    steps = ops.fleet_transitions(table(spark, rows, EVENTS, "ts"), 2, at(spark, 100), clustered=False)
    assert [r[3] for r in sorted(seconds(steps), key=lambda r: (r[0], r[1]))] == [
        "LAUNCHING", "STORED", "STORED", "STORED", "LAUNCHING", "ABSENT", "LAUNCHING", "DEAD", "REJECTED",
    ]


@POLICIES
def test_registration_attempts(spark, policy):
    rng = random.Random(9)
    rows = [(f"k{k}", float(rng.randint(0, 20)), i * 1000 + k, rng.random() < 0.2) for k in range(200) for i in range(rng.randint(1, 9) + (100 if k == 0 else 0))]
    df = table(spark, rows, "key string, ts double, event_id bigint, ok boolean", "ts")
    got = {r[0]: r[1:] for r in seconds(ops.registration_attempts(df, policy))}
    assert got == {k: folds.attempts(e) for k, e in by_key(rows).items()}


def test_three_failed_attempts(spark):
    rows = [("a", float(t), t, t == 3) for t in range(4)]
    df = table(spark, rows, "key string, ts double, event_id bigint, ok boolean", "ts")
    assert seconds(ops.registration_attempts(df)) == [("a", 4, 3.0)]


def test_flagship_shuffles_rows_once(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    log = events.select(F.col("user_id").cast("string").alias("instance_id"), "ts", "event_id", F.lit("UP").alias("kind"))
    plan = ops.fleet_state(log, 90, F.lit("2030-01-01").cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan  # only the needed columns
