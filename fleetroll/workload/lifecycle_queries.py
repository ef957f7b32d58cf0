"""Queries over deploys, correlation and event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import operators as ops
from ..plans import DEFAULT_SKEW, SkewPolicy
from . import fixtures as fx
from .register import address_text, map_text, query
from .views_sql import with_views

HOUR = 3600
DAY = 24 * HOUR

# Treats keys as hot from a few rows on, so that the split plans run on test tables as well.
TINY = SkewPolicy(group_rows=8, probe_bytes=0, sketch_buckets=8)


# -- deploys ---------------------------------------------------------------------------------------------------------


def _deploys(spark, sf):
    return ops.expand_deploys(fx.identified_requests(spark, sf), fx.container_table(spark, sf))


@query(
    "jn_3",
    with_views(
        "expanded",
        """SELECT request_id, instance_id, container_name, ordinal::BIGINT AS ordinal, 'DEPLOYING' AS status, cpus::BIGINT AS cpus,
          CASE WHEN priority = '2-HIGH' THEN '-Xms1G,' ELSE '' END || jvm_args AS jvm_args,
          'app.mode=' || CASE WHEN priority = '1-URGENT' THEN 'urgent' ELSE 'base' END || ',app.nation=' || s_nationkey AS properties
        FROM expanded""",
    ),
)
def jn_3(spark, sf):
    return _deploys(spark, sf).instances.select(
        "request_id", "instance_id", "container_name", "ordinal", "status", "cpus",
        F.array_join("jvm_args", ",").alias("jvm_args"), map_text("jvm_properties").alias("properties"),
    )


@query("jn_3_unknown", with_views("f4 defs", "SELECT request_id, seq, name, 'NOT_FOUND' AS outcome FROM f4 ANTI JOIN defs USING (name)"))
def jn_3_unknown(spark, sf):
    return _deploys(spark, sf).unknown


@query(
    "agg_1",
    with_views(
        "f4 defs expanded",
        """SELECT f4.request_id, f4.name AS container_name, 0::BIGINT AS part,
          coalesce(string_agg(instance_id, ',' ORDER BY ordinal), '') AS instance_ids
        FROM f4 SEMI JOIN defs USING (name) LEFT JOIN expanded e ON e.request_id = f4.request_id GROUP BY 1, 2""",
    ),
)
def agg_1(spark, sf):
    return ops.submitted_instances(_deploys(spark, sf)).withColumn("instance_ids", F.array_join("instance_ids", ","))


SET_4_SQL = """SELECT instance_id, 0::BIGINT AS step, 'DEPLOYING' AS status, NULL::VARCHAR AS error FROM expanded UNION ALL
  SELECT instance_id, 1, CASE WHEN (ordinal + seq) % 7 <> 0 THEN 'LAUNCHING' ELSE 'DEPLOY_FAILED' END,
    CASE WHEN (ordinal + seq) % 7 = 0 THEN 'no resources' END FROM expanded"""


@query("set_4", with_views("expanded", SET_4_SQL))
def set_4(spark, sf):
    instances = _deploys(spark, sf).instances
    return ops.deploy_status_log(instances, fx.deploy_results(instances))


WIN_6_SQL = "SELECT o_orderkey AS seq, (row_number() OVER (ORDER BY o_orderkey) - 1) % {m} AS slot FROM orders"


@query("win_6", WIN_6_SQL.format(m=32767))
def win_6(spark, sf):
    return ops.cyclic_slots(fx.deploy_requests(spark, sf).select("seq"), ["seq"])


@query("win_6_split", WIN_6_SQL.format(m=1000))
def win_6_split(spark, sf):
    policy = SkewPolicy(group_rows=500, probe_bytes=0)
    return ops.cyclic_slots(fx.deploy_requests(spark, sf).select("seq"), ["seq"], 1000, policy)


JN_9_SQL = """SELECT l_orderkey AS slot, epoch_us(l_shipdate) AS offered_us, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber,
  CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders) AND row_number() OVER
    (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) = 1 THEN 'LAUNCHED' ELSE 'RELEASED' END AS outcome
FROM lineitem"""


def _match_offers(spark, sf, policy=DEFAULT_SKEW):
    order = ["offered_us", "l_partkey", "l_suppkey", "l_linenumber"]
    return ops.match_offers(fx.offers(spark, sf), fx.pending_slots(spark, sf), order, policy)


@query("jn_9", JN_9_SQL)
def jn_9(spark, sf):
    return _match_offers(spark, sf)


@query("jn_9_split", JN_9_SQL)
def jn_9_split(spark, sf):
    return _match_offers(spark, sf, SkewPolicy(group_rows=4, probe_bytes=0))


# -- requests, children, logs, configuration -------------------------------------------------------------------------

YEAR_US = 365 * 86_400_000_000


def _correlate_sql(requests: str, answers: str) -> str:
    """Every request with the answer that it owns: the first one after it, if no request of its id comes before that."""
    return f"""SELECT q.request_id, q.us AS asked_at, CASE WHEN p.us IS NOT NULL AND nth_same = 1 THEN
          CASE WHEN p.us <= q.us + {YEAR_US} THEN 'ANSWERED' ELSE 'TIMED_OUT' END
        WHEN nth_same > 1 OR last_us > q.us THEN 'SUPERSEDED' ELSE 'UNANSWERED' END AS outcome,
      CASE WHEN nth_same = 1 THEN p.response_id END AS response_id, CASE WHEN nth_same = 1 THEN p.us END AS answered_at
    FROM (SELECT *, row_number() OVER (PARTITION BY request_id, us) AS nth_same, max(us) OVER (PARTITION BY request_id) AS last_us FROM {requests}) q
    LEFT JOIN (SELECT * FROM {answers} WHERE asked_us IS NOT NULL AND nth = 1) p ON p.request_id = q.request_id AND p.asked_us = q.us"""


@query(
    "jn_6",
    with_views(
        "f6_requests f6_responses",
        f"""WITH firsts AS (SELECT q.request_id, q.us AS asked_at, min((p.us, p.response_id)) AS f FROM f6_requests q
          LEFT JOIN f6_responses p ON p.request_id = q.request_id AND p.us >= q.us GROUP BY 1, 2)
        SELECT request_id, asked_at, CASE WHEN f IS NULL OR f[1] IS NULL THEN 'UNANSWERED' WHEN f[1] <= asked_at + {YEAR_US} THEN 'ANSWERED'
          ELSE 'TIMED_OUT' END AS outcome, f[2] AS response_id, f[1] AS answered_at FROM firsts""",
    ),
)
def jn_6(spark, sf):
    asked, answers = fx.requests_and_responses(spark, sf)
    return ops.correlate_responses(asked, answers, timeout=365 * DAY)


JN_6_REPEATED = with_views("f6_owned", _correlate_sql("f6_repeated", "f6_owned"))
JN_6_ORPHANS = with_views(
    "f6_owned",
    """SELECT request_id, response_id, us AS ts, 'Sender with ID ' || request_id || ' was not found' AS message
    FROM f6_owned WHERE asked_us IS NULL OR nth > 1""",
)


@query("jn_6_repeated", JN_6_REPEATED)
def jn_6_repeated(spark, sf):
    """Ids that are asked again."""
    return ops.correlate_responses(*fx.repeated_requests_and_responses(spark, sf), timeout=365 * DAY)


@query("jn_6_repeated_split", JN_6_REPEATED)
def jn_6_repeated_split(spark, sf):
    policy = SkewPolicy(group_rows=6, probe_bytes=0)
    return ops.correlate_responses(*fx.repeated_requests_and_responses(spark, sf), timeout=365 * DAY, policy=policy)


@query("jn_6_orphans", JN_6_ORPHANS)
def jn_6_orphans(spark, sf):
    return ops.orphan_responses(*fx.repeated_requests_and_responses(spark, sf))


TOP_2_SQL = with_views(
    "f6_requests f6_responses",
    f"""SELECT q.request_id AS key, q.us AS started_at,
      CASE WHEN min(p.us) <= q.us + {90 * 86_400_000_000} THEN 'JOINED' ELSE 'TIMED_OUT' END AS outcome,
      CASE WHEN min(p.us) <= q.us + {90 * 86_400_000_000} THEN min(p.us) ELSE q.us + {90 * 86_400_000_000} END AS decided_at
    FROM f6_requests q LEFT JOIN f6_responses p ON p.request_id = q.request_id AND p.us >= q.us GROUP BY q.request_id, q.us""",
)


def _join_deadlines(spark, sf, policy=DEFAULT_SKEW):
    asked, answers = fx.requests_and_responses(spark, sf)
    starts = asked.withColumnRenamed("request_id", "key")
    return ops.join_deadlines(starts, answers.withColumnRenamed("request_id", "key"), 90 * DAY, policy)


@query("top_2", TOP_2_SQL)
def top_2(spark, sf):
    return _join_deadlines(spark, sf)


@query("top_2_split", TOP_2_SQL)
def top_2_split(spark, sf):
    return _join_deadlines(spark, sf, SkewPolicy(group_rows=6, probe_bytes=0))


@query(
    "agg_3",
    """SELECT l_orderkey AS parent, bool_and(l_linestatus = 'F') AS finished,
      CASE WHEN bool_and(l_linestatus = 'F') THEN epoch_us(max(l_shipdate)) END AS finished_at FROM lineitem GROUP BY 1""",
)
def agg_3(spark, sf):
    return ops.completion_barrier(fx.children(spark, sf))


@query(
    "agg_4",
    """WITH firsts AS (SELECT o_custkey, min((o_orderdate, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END, o_orderpriority))
        FILTER (o_orderstatus <> 'P') AS f FROM orders GROUP BY 1)
    SELECT o_custkey AS key, coalesce(f[3], 'PENDING') AS outcome, CASE WHEN f[3] = 'RUNNING' THEN 'h' || (f[2] % 200) END AS host,
      CASE WHEN f[3] = 'FAILED' THEN 'Unexpected state: FAILED' || chr(10) || f[4] END AS message FROM firsts""",
)
def agg_4(spark, sf):
    return ops.first_terminal_state(fx.state_log(spark, sf))


@query(
    "win_5",
    with_views(
        "f12",
        "SELECT key, layer::BIGINT AS layer, seq, value FROM f12 QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer, seq DESC) = 1",
    ),
)
def win_5(spark, sf):
    return ops.layered_config(fx.config_layers(spark, sf))


# -- lifecycle -------------------------------------------------------------------------------------------------------

SIX_HOURS = 6 * HOUR
LAUNCH_US = SIX_HOURS * 1_000_000

# Deaths by launch timeout: run heads, the head after each launching run, the first missed deadline.
DEATHS = f"""base AS (SELECT *, kind = 'LAUNCHING' AND coalesce(lag(kind) OVER w = 'LAUNCHING', false) AS inside
    FROM f3 WHERE kind IN ('DEPLOYING', 'LAUNCHING', 'UP', 'DEPLOY_FAILED') WINDOW w AS (PARTITION BY instance_id ORDER BY us, event_id)),
  heads AS (SELECT *, coalesce(lead(us) OVER (PARTITION BY instance_id ORDER BY us, event_id), {{as_of}}) AS next_us FROM base WHERE NOT inside),
  deaths AS (SELECT instance_id, min(us) + {LAUNCH_US} AS dead_us FROM heads WHERE kind = 'LAUNCHING' AND next_us > us + {LAUNCH_US} GROUP BY 1)"""
LAST = "(SELECT max(epoch_us(ts)) FROM events)"
FOREVER = "9000000000000000"

# The state after each event, member events before the first base event left out.
STEPS = """steps AS (SELECT instance_id, us, event_id, CASE
      WHEN us > dead_us THEN 'REJECTED' WHEN b.kind = 'DEPLOY_FAILED' THEN 'ABSENT' WHEN b.kind <> 'UP' THEN b.kind
      WHEN removed THEN 'ABSENT' WHEN reach = 'UNREACHABLE' THEN 'UNREACHABLE' ELSE 'UP' END AS state
    FROM (SELECT *, bool_or(kind = 'REMOVED') OVER g AS removed,
        last_value(CASE WHEN kind IN ('UNREACHABLE', 'REACHABLE') THEN kind END IGNORE NULLS) OVER g AS reach,
        first_value(kind) OVER g AS head
      FROM (SELECT *, count(*) FILTER (kind IN ('DEPLOYING', 'LAUNCHING', 'UP', 'DEPLOY_FAILED')) OVER w AS grp
        FROM f3 WINDOW w AS (PARTITION BY instance_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
      WHERE grp > 0 WINDOW g AS (PARTITION BY instance_id, grp ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) s
    LEFT JOIN deaths USING (instance_id), LATERAL (SELECT s.head AS kind) b)"""

WIN_1_SQL = with_views(
    "f3",
    f"""WITH {DEATHS.format(as_of=LAST)}, {STEPS}
    SELECT instance_id, CASE WHEN dead_us IS NOT NULL THEN 'DEAD' ELSE state END AS state, dead_us AS dead_at
    FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY us DESC, event_id DESC) = 1)
    LEFT JOIN deaths USING (instance_id)""",
)


def _last_ts(spark, sf):
    """Time of the last event, read from the raw table rather than from the derived events."""
    return fx.events(spark, sf).select(F.max("ts")).scalar()


def _fleet_state(spark, sf, policy=DEFAULT_SKEW):
    return ops.fleet_state(fx.lifecycle_events(spark, sf, policy), SIX_HOURS, _last_ts(spark, sf), policy=policy)


@query("win_1", WIN_1_SQL)
def win_1(spark, sf):
    return _fleet_state(spark, sf)


@query("win_1_split", WIN_1_SQL)
def win_1_split(spark, sf):
    return _fleet_state(spark, sf, TINY)


@query(
    "win_1_counts",
    f"SELECT state, count(*) AS instances FROM ({WIN_1_SQL}) GROUP BY 1",
)
def win_1_counts(spark, sf):
    """Flagship: how many instances are in which state."""
    return _fleet_state(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("instances"))


def transitions_sql(as_of: str, clustered: bool = True) -> str:
    # Without a cluster the local registry holds an instance only until it is UP, so member events do not meet it.
    steps = STEPS if clustered else STEPS.replace("WHEN removed THEN", "WHEN true THEN 'STORED' WHEN removed THEN")
    return with_views(
        "f3",
        f"""WITH {DEATHS.format(as_of=as_of)}, {steps}
        SELECT instance_id, us AS ts, event_id, state FROM steps
        UNION ALL SELECT instance_id, dead_us, NULL, 'DEAD' FROM deaths""",
    )


@query("win_1_transitions", transitions_sql(LAST))
def win_1_transitions(spark, sf):
    return ops.fleet_transitions(fx.lifecycle_events(spark, sf), SIX_HOURS, _last_ts(spark, sf))


@query("win_1_transitions_split", transitions_sql(LAST))
def win_1_transitions_split(spark, sf):
    return ops.fleet_transitions(fx.lifecycle_events(spark, sf), SIX_HOURS, _last_ts(spark, sf), policy=TINY)


@query("win_1_unclustered", transitions_sql(LAST, clustered=False))
def win_1_unclustered(spark, sf):
    return ops.fleet_transitions(fx.lifecycle_events(spark, sf), SIX_HOURS, _last_ts(spark, sf), clustered=False)


@query("win_2", with_views("f3", f"WITH {DEATHS.format(as_of=LAST)} SELECT instance_id, dead_us AS dead_at FROM deaths"))
def win_2(spark, sf):
    return ops.launch_timeouts(fx.lifecycle_events(spark, sf), SIX_HOURS, _last_ts(spark, sf))


WIN_2_REJECTED = with_views(
    "f3",
    f"""WITH {DEATHS.format(as_of=LAST)} SELECT instance_id, event_id, us AS ts, kind, dead_us AS dead_at
    FROM f3 JOIN deaths USING (instance_id) WHERE us > dead_us""",
)


@query("win_2_rejected", WIN_2_REJECTED)
def win_2_rejected(spark, sf):
    return ops.rejected_updates(fx.lifecycle_events(spark, sf), SIX_HOURS)


@query("win_2_rejected_split", WIN_2_REJECTED)
def win_2_rejected_split(spark, sf):
    return ops.rejected_updates(fx.lifecycle_events(spark, sf), SIX_HOURS, TINY)


BEAT_US = 16 * 3_600_000_000


def _liveness_sql(gaps: str) -> str:
    """``gaps`` has key, us, gap to the next beat, and n: 1 for a beat, 0 for the start of a clock."""
    return f"""WITH gaps AS ({gaps}),
      ends AS (SELECT key, min(us + 3 * {BEAT_US}) FILTER (gap > 3 * {BEAT_US}) AS end_us FROM gaps GROUP BY 1)
    SELECT key, coalesce(sum(n) FILTER (end_us IS NULL OR us <= end_us), 0)::BIGINT AS beats,
      sum(CASE WHEN end_us IS NULL OR us <= end_us THEN least(gap // {BEAT_US}, 3) ELSE 0 END)::BIGINT AS missed,
      end_us AS terminated_at, coalesce(sum(n) FILTER (us > end_us), 0)::BIGINT AS late_beats
    FROM gaps JOIN ends USING (key) GROUP BY key, end_us"""


def liveness_sql(as_of: str) -> str:
    return _liveness_sql(f"""SELECT user_id AS key, epoch_us(ts) AS us, 1 AS n,
        coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), {as_of}) - epoch_us(ts) AS gap FROM events""")


def started_liveness_sql(as_of: str) -> str:
    """Every customer's clock starts with the first event of all."""
    log = """SELECT user_id AS key, epoch_us(ts) AS us, 1 AS n FROM events
        UNION ALL SELECT c_custkey, (SELECT epoch_us(min(ts)) FROM events), 0 FROM customer"""
    return _liveness_sql(f"SELECT *, coalesce(lead(us) OVER (PARTITION BY key ORDER BY us, n), {as_of}) - us AS gap FROM ({log})")


@query("win_3", liveness_sql(LAST))
def win_3(spark, sf):
    beats = fx.events(spark, sf).select(F.col("user_id").alias("key"), "ts")
    return ops.heartbeat_liveness(beats, 16 * HOUR, 3)


def outage_sql(as_of: str) -> str:
    deadline = 48 * 3_600_000_000
    return f"""SELECT key, min(us) AS down_at, min(us) + {deadline} AS terminated_at FROM (
      SELECT user_id AS key, epoch_us(ts) AS us, event_type, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), {as_of}) AS next_us
      FROM events WHERE event_type IN ('error', 'view'))
    WHERE event_type = 'error' AND next_us - us > {deadline} GROUP BY key"""


def coordinator_events(spark, sf):
    kind = F.col("event_type")
    return (
        fx.events(spark, sf)
        .where(kind.isin("error", "view"))
        .select(F.col("user_id").alias("key"), "ts", "event_id", (kind == "error").alias("is_down"))
    )


@query("win_3_silent", started_liveness_sql(LAST))
def win_3_silent(spark, sf):
    """With a clock that starts before the first beat, keys without any beat end as well."""
    beats = fx.events(spark, sf).select(F.col("user_id").alias("key"), "ts")
    return ops.heartbeat_liveness(beats, 16 * HOUR, 3, starts=fx.clock_starts(spark, sf))


@query("win_4", outage_sql("(SELECT max(epoch_us(ts)) FROM events WHERE event_type IN ('error', 'view'))"))
def win_4(spark, sf):
    return ops.outage_terminations(coordinator_events(spark, sf), 24 * HOUR)


WIN_7_SQL = with_views(
    "f3",
    """WITH tries AS (SELECT instance_id AS key, us, event_id, kind = 'UP' AS ok FROM f3 WHERE kind IN ('UP', 'UNREACHABLE')),
      firsts AS (SELECT key, min((us, event_id)) FILTER (ok) AS f FROM tries GROUP BY 1)
    SELECT key, count(*) FILTER (f IS NULL OR (us, event_id) <= f) AS attempts, f[1] AS registered_at
    FROM tries JOIN firsts USING (key) GROUP BY key, f""",
)


def _attempts(spark, sf, policy=DEFAULT_SKEW):
    log = (
        fx.lifecycle_events(spark, sf, policy)
        .where(F.col("kind").isin("UP", "UNREACHABLE"))
        .select(F.col("instance_id").alias("key"), "ts", "event_id", (F.col("kind") == "UP").alias("ok"))
    )
    return ops.registration_attempts(log, policy)


@query("win_7", WIN_7_SQL)
def win_7(spark, sf):
    return _attempts(spark, sf)


@query("win_7_split", WIN_7_SQL)
def win_7_split(spark, sf):
    return _attempts(spark, sf, TINY)


@query("jn_4", with_views("f5_matched", "SELECT event_id, us AS ts, kind, address, instance_id FROM f5_matched"))
def jn_4(spark, sf):
    matched, _ = ops.match_members(fx.member_events(spark, sf), fx.registry(spark, sf))
    return matched.select("event_id", "ts", "kind", address_text("address").alias("address"), "instance_id")


@query("jn_4_unknown", with_views("f5 by_address", "SELECT event_id, kind, address FROM f5 ANTI JOIN by_address USING (address)"))
def jn_4_unknown(spark, sf):
    _, unknown = ops.match_members(fx.member_events(spark, sf), fx.registry(spark, sf))
    return unknown.select("event_id", "kind", address_text("address").alias("address"))


def auto_down_sql(poll_us: int, members: str = "f5_matched") -> str:
    return with_views(
        "f5_matched",
        f"""WITH turns AS (SELECT *, kind = 'UNREACHABLE' AS away, coalesce(lag(kind) OVER w = 'UNREACHABLE', false) AS was_away
            FROM {members} WINDOW w AS (PARTITION BY instance_id ORDER BY us, event_id)),
          episodes AS (SELECT instance_id, c_custkey, us AS start_us, lead(us) OVER (PARTITION BY instance_id ORDER BY us, event_id) AS end_us, away
            FROM turns WHERE away <> was_away),
          polls AS (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN start_us + ((greatest(0, gone - start_us) + {poll_us} - 1) // {poll_us}) * {poll_us} END AS poll_us
            FROM (SELECT *, (SELECT min(epoch_us(ts)) FROM events) + (c_custkey % 30) * 86400000000 AS gone FROM episodes WHERE away))
        SELECT instance_id, start_us AS unreachable_at, end_us AS ended_at, CASE WHEN end_us IS NULL OR poll_us < end_us THEN poll_us END AS down_at FROM polls""",
    )


IS_EXITING = "(kind = 'UNREACHABLE' AND event_id % 7 = 0)"


def exiting_sql(poll_us: int) -> str:
    """Every seventh event that an exiting member causes has no episode; it downs the member at once."""
    polled = auto_down_sql(poll_us, f"(SELECT * FROM f5_matched WHERE NOT {IS_EXITING})")
    left = with_views("f5_matched", f"SELECT instance_id, us FROM f5_matched WHERE {IS_EXITING}")
    return f"""SELECT *, CASE WHEN down_at IS NOT NULL THEN 'DOWNED' WHEN ended_at IS NOT NULL THEN 'ENDED' ELSE 'WAITING' END AS outcome
      FROM ({polled}) UNION ALL SELECT instance_id, us, NULL, us, 'EXITING' FROM ({left})"""


def matched_members(spark, sf):
    matched, _ = ops.match_members(fx.member_events(spark, sf), fx.registry(spark, sf))
    return matched.select("instance_id", "ts", "event_id", "kind")


def exiting_members(spark, sf):
    return matched_members(spark, sf).withColumn("exiting", F.col("event_id") % 7 == 0)


def _auto_down(spark, sf, policy=DEFAULT_SKEW):
    return ops.auto_down(matched_members(spark, sf), fx.deregistrations(spark, sf), policy=policy).drop("outcome")


@query("jn_8", auto_down_sql(30_000_000))
def jn_8(spark, sf):
    return _auto_down(spark, sf)


@query("jn_8_split", auto_down_sql(30_000_000))
def jn_8_split(spark, sf):
    return _auto_down(spark, sf, TINY)


@query("jn_8_exiting", exiting_sql(30_000_000))
def jn_8_exiting(spark, sf):
    return ops.auto_down(exiting_members(spark, sf), fx.deregistrations(spark, sf))
