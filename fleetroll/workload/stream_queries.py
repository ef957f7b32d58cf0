"""Queries that run a stream over records written from the tables; their SQL is that of the batch form.

Every stream gets one closing row far behind the last event, so that the watermark passes all deadlines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators as ops
from .. import sources, streaming
from . import fixtures as fx
from .lifecycle_queries import (
    DAY,
    FOREVER,
    HOUR,
    JN_6_ORPHANS,
    JN_6_REPEATED,
    SIX_HOURS,
    auto_down_sql,
    coordinator_events,
    exiting_members,
    exiting_sql,
    liveness_sql,
    matched_members,
    outage_sql,
    started_liveness_sql,
    transitions_sql,
)
from .register import query
from .views_sql import LOOKUP_IDS, instance_id, with_views

WATERMARK = "1 hour"
BUCKETS = 4096  # for fleets of some hundred thousand ids
END = "~end"


def _closing(df: DataFrame, ts: str, years: int, **values) -> DataFrame:
    """One row ``years`` behind the last one of ``df``, null but for ``values``."""
    at = F.timestamp_micros(F.unix_micros(F.max(ts)) + F.lit(years * 365 * 86_400_000_000))
    last = df.agg(at.alias("_at"))
    columns = [
        (F.col("_at") if f.name == ts else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name) for f in df.schema
    ]
    return last.select(*columns)


def _as_stream(
    df: DataFrame, name: str, ts: str = "ts", years: int = 1, watermark: str = WATERMARK, files: int | None = None, **closing
) -> DataFrame:
    """``df`` and its closing row, written as files and read back as a stream; with ``files`` one file a micro-batch."""
    spark = df.sparkSession
    streaming.use_rocksdb(spark)
    path = sources.scratch_path(spark, name)
    (df.repartition(files) if files else df).write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _closing(written, ts, years, **closing).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema)
    return (source.option("maxFilesPerTrigger", 1) if files else source).parquet(path).withWatermark(ts, watermark)


def _as_table(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = sources.scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _message_stream(spark, sf, name):
    """F3 as JSON messages: single updates for odd event ids, batches of an instance and day for the others."""
    path = sources.scratch_path(spark, name)
    events = fx.lifecycle_events(spark, sf)
    single = events.where(F.col("event_id") % 2 == 1)
    batches = (
        events.where(F.col("event_id") % 2 == 0)
        .groupBy("instance_id", F.date_trunc("day", "ts").alias("day"))
        .agg(F.collect_list(F.struct("instance_id", "ts", "event_id", "kind")).alias("updates"))
        .select("updates")
    )
    single.write.json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    batches.write.mode("append").json(path, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    streaming.use_rocksdb(spark)
    return sources.stream_updates(spark, path, WATERMARK)


@query("src_3", with_views("f3", "SELECT instance_id, us AS ts, event_id, kind FROM f3"))
def src_3(spark, sf):
    return streaming.run_to_table(_message_stream(spark, sf, "src3_in"), "src3")


@query(
    "snk_2",
    with_views(
        "f3",
        """SELECT instance_id, us AS ts, event_id, kind FROM f3
        QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY us DESC, event_id DESC) = 1""",
    ),
)
def snk_2(spark, sf):
    path = sources.scratch_path(spark, "registry")
    updates = _message_stream(spark, sf, "snk2_in")
    writer = sources.upsert_registry(updates, f"{path}/table")
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sources.read_registry(spark, f"{path}/table")


@query("str_1", transitions_sql(FOREVER))
def str_1(spark, sf):
    updates = _as_stream(fx.lifecycle_events(spark, sf), "str1_in", instance_id=END, event_id=0, kind="REACHABLE")
    return streaming.run_to_table(streaming.stream_fleet_state(updates, SIX_HOURS, buckets=BUCKETS), "str1")


@query("str_1_unclustered", transitions_sql(FOREVER, clustered=False))
def str_1_unclustered(spark, sf):
    updates = _as_stream(fx.lifecycle_events(spark, sf), "str1u_in", instance_id=END, event_id=0, kind="REACHABLE")
    return streaming.run_to_table(streaming.stream_fleet_state(updates, SIX_HOURS, clustered=False, buckets=BUCKETS), "str1u")


@query("str_1_resumed", transitions_sql(FOREVER))
def str_1_resumed(spark, sf):
    """The first half of the time as a batch; the stream goes on from what it carries."""
    events = fx.lifecycle_events(spark, sf)
    span = fx.events(spark, sf).select((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))).alias("s"))
    middle = F.timestamp_micros((span.scalar() / 2).cast("bigint"))
    first, second = events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)
    # No launch is overdue before time began: the stream ends those that are open.
    done = ops.fleet_transitions(first, SIX_HOURS, F.lit("1970-01-01").cast("timestamp"))
    carry = _as_table(ops.fleet_carry(first, SIX_HOURS), "str1r_carry")
    updates = _as_stream(second, "str1r_in", instance_id=END, event_id=0, kind="REACHABLE")
    rest = streaming.run_to_table(streaming.stream_fleet_state(updates, SIX_HOURS, initial=carry, buckets=BUCKETS), "str1r")
    return done.unionByName(rest)


def _liveness_sums(ends: DataFrame) -> DataFrame:
    return ends.where(F.col("key") >= 0).groupBy("key").agg(
        F.sum("beats").alias("beats"), F.sum("missed").alias("missed"),
        F.max("terminated_at").alias("terminated_at"), F.sum("late_beats").alias("late_beats"),
    )


@query("str_2", f"SELECT key, terminated_at, late_beats FROM ({liveness_sql(FOREVER)})")
def str_2(spark, sf):
    beats = fx.events(spark, sf).select(F.col("user_id").alias("key"), "ts")
    ends = streaming.stream_heartbeat(_as_stream(beats, "str2_in", key=-1), 16 * HOUR, 3, buckets=BUCKETS)
    return _liveness_sums(streaming.run_to_table(ends, "str2")).drop("beats", "missed")


@query("str_2_silent", started_liveness_sql(FOREVER))
def str_2_silent(spark, sf):
    """The clock of every customer starts with the first event of all; most never send a beat, the others one per event."""
    events = fx.events(spark, sf)
    beats = events.select(F.col("user_id").alias("key"), "ts")
    starts = fx.clock_starts(spark, sf)
    ends = streaming.stream_heartbeat(
        _as_stream(beats, "str2s_in", key=-1), 16 * HOUR, 3, starts=_as_stream(starts, "str2s_starts", key=-1, years=2),
        buckets=BUCKETS,
    )
    return _liveness_sums(streaming.run_to_table(ends, "str2s"))


@query(
    "str_3",
    with_views(
        "f6_requests f6_responses",
        f"""WITH firsts AS (SELECT q.request_id, q.us AS asked_at, min((p.us, p.response_id)) FILTER (p.us IS NOT NULL) AS f FROM f6_requests q
          LEFT JOIN f6_responses p ON p.request_id = q.request_id AND p.us BETWEEN q.us AND q.us + {90 * 86_400_000_000} GROUP BY 1, 2)
        SELECT request_id, asked_at, CASE WHEN f IS NULL THEN 'TIMED_OUT' ELSE 'ANSWERED' END AS outcome,
          f[2] AS response_id, f[1] AS answered_at FROM firsts""",
    ),
)
def str_3(spark, sf):
    """Requests end at their deadline."""
    asked, answers = fx.requests_and_responses(spark, sf)
    requests = _as_stream(asked, "str3_asked", request_id=-1)
    responses = _as_stream(answers, "str3_answers", request_id=-2)
    outcomes = streaming.run_to_table(streaming.stream_correlate(requests, responses, 90 * DAY, slot=30 * DAY, buckets=BUCKETS), "str3")
    return outcomes.where((F.col("request_id") >= 0) & (F.col("outcome") != "ORPHAN")).drop("message")


@query(
    "str_3_late",
    f"""SELECT request_id, asked_at, outcome, response_id, answered_at, NULL AS message FROM ({JN_6_REPEATED})
    UNION ALL SELECT request_id, NULL, 'ORPHAN', response_id, ts, message FROM ({JN_6_ORPHANS})""",
)
def str_3_late(spark, sf):
    """Requests that come again and answers that come early, late and twice: the rows of ``jn_6_repeated`` and ``jn_6_orphans``."""
    asked, answers = fx.repeated_requests_and_responses(spark, sf)
    requests = _as_stream(asked, "str3l_asked", years=30, request_id=-1)
    responses = _as_stream(answers, "str3l_answers", years=30, request_id=-2)
    found = streaming.stream_correlate(requests, responses, 365 * DAY, give_up=20 * 365 * DAY, slot=30 * DAY, buckets=BUCKETS)
    return streaming.run_to_table(found, "str3l").where(F.col("request_id") >= 0)


def _auto_down_stream(spark, sf, name, events):
    gone = fx.deregistrations(spark, sf).where(F.col("deregistered_at").isNotNull())
    deregistered = _as_stream(gone, f"{name}_gone", ts="deregistered_at", instance_id=END)
    return streaming.run_to_table(streaming.stream_auto_down(events, deregistered, buckets=BUCKETS), name)


@query("str_4", f"SELECT instance_id, unreachable_at, down_at FROM ({auto_down_sql(30_000_000)}) WHERE down_at IS NOT NULL")
def str_4(spark, sf):
    events = _as_stream(matched_members(spark, sf), "str4_events", instance_id=END, event_id=0, kind="REACHABLE")
    return _auto_down_stream(spark, sf, "str4", events).drop("outcome")


@query(
    "str_4_exiting",
    f"SELECT instance_id, unreachable_at, down_at, outcome FROM ({exiting_sql(30_000_000)}) WHERE down_at IS NOT NULL",
)
def str_4_exiting(spark, sf):
    events = _as_stream(exiting_members(spark, sf), "str4e_events", instance_id=END, event_id=0, kind="REACHABLE")
    return _auto_down_stream(spark, sf, "str4e", events)


@query("str_5", outage_sql(FOREVER))
def str_5(spark, sf):
    events = _as_stream(coordinator_events(spark, sf), "str5_in", key=-1, event_id=0, is_down=False)
    return streaming.run_to_table(streaming.stream_outage(events, 24 * HOUR, buckets=BUCKETS), "str5").where(F.col("key") >= 0)


@query(
    "str_6",
    with_views(
        "f3 local_registry",
        f"""SELECT i AS instance_id, us AS ts, event_id, event_type, value, CASE WHEN i NOT IN (SELECT instance_id FROM local_registry)
            AND row_number() OVER (PARTITION BY i ORDER BY us, event_id) = 1 THEN 'REGISTERED' ELSE 'ALREADY_EXISTS' END AS outcome
        FROM (SELECT {instance_id(f"event_id % {LOOKUP_IDS}")} AS i, epoch_us(ts) AS us, event_id, event_type, value FROM events)""",
    ),
)
def str_6(spark, sf):
    """Several files, each over the whole time; the watermark waits for the last one."""
    key = F.col("event_id") % fx.lookup_ids(spark, sf)
    new = fx.events(spark, sf).select(fx.instance_id(key).alias("instance_id"), "ts", "event_id", "event_type", "value")
    stream = _as_stream(new, "str6_in", years=3, watermark="400 days", files=3, instance_id=END)
    first = streaming.stream_register(stream, fx.local_registry(spark, sf), ["event_id"], buckets=BUCKETS)
    return streaming.run_to_table(first, "str6").where(F.col("instance_id") != END)
