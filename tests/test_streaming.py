"""Streams give the rows of their batch form, in many micro-batches and with events out of order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetroll import operators as ops
from fleetroll import sources, streaming
from tests import folds
from tests.helpers import seconds, table
from tests.test_lifecycle import EVENTS, KINDS, random_events

FAR = 100_000.0
START = 1000.0  # a stream takes rows at the epoch, its first watermark, for late ones


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    streaming.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def shifted(rows):
    return [(key, START + ts, *rest) for key, ts, *rest in rows]


def as_stream(spark, path, rows, schema, ts, end, delay, batches=4, late=6.0):
    """Rows in batches by time, each row up to ``late`` seconds out of order, then the closing row ``end``."""
    rng = random.Random(1)
    at = [c.split()[0] for c in schema.split(", ")].index(ts)
    arrival = sorted(rows, key=lambda r: r[at] + rng.random() * late)
    size = -(-len(arrival) // batches)
    for i in range(0, len(arrival), size):
        table(spark, arrival[i : i + size], schema, ts).coalesce(1).write.mode("append").parquet(path)
    table(spark, [end], schema, ts).coalesce(1).write.mode("append").parquet(path)
    shape = spark.read.parquet(path).schema
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path).withWatermark(ts, delay)


def test_fleet_state(spark, tmp_path):
    rows = shifted(random_events(3, 25, KINDS, hot=40, span=60))
    updates = as_stream(spark, str(tmp_path), rows, EVENTS, "ts", ("~", FAR, 0, "REACHABLE"), "10 seconds")
    got = seconds(streaming.run_to_table(streaming.stream_fleet_state(updates, 3), "t1"))
    want = seconds(ops.fleet_transitions(table(spark, rows, EVENTS, "ts"), 3, F.lit("2030-01-01").cast("timestamp")))
    assert got == want


@pytest.mark.parametrize("slot, buckets", [(4, 2), (60, 1000)])
def test_slots_and_buckets_do_not_matter(spark, tmp_path, slot, buckets):
    """Hundreds of events of one key, in slots of a few or of all of them, with many keys a bucket or one."""
    rows = shifted(random_events(9, 6, KINDS, hot=120, span=90))
    updates = as_stream(spark, str(tmp_path), rows, EVENTS, "ts", ("~", FAR, 0, "REACHABLE"), "10 seconds", batches=3)
    got = seconds(streaming.run_to_table(streaming.stream_fleet_state(updates, 3, slot=slot, buckets=buckets), "t0"))
    want = seconds(ops.fleet_transitions(table(spark, rows, EVENTS, "ts"), 3, F.lit("2030-01-01").cast("timestamp")))
    assert got == want


def test_fleet_state_without_a_cluster(spark, tmp_path):
    rows = shifted(random_events(10, 12, KINDS, hot=30, span=60))
    updates = as_stream(spark, str(tmp_path), rows, EVENTS, "ts", ("~", FAR, 0, "REACHABLE"), "10 seconds", batches=2)
    got = seconds(streaming.run_to_table(streaming.stream_fleet_state(updates, 3, clustered=False, slot=4), "t7"))
    batch = ops.fleet_transitions(table(spark, rows, EVENTS, "ts"), 3, F.lit("2030-01-01").cast("timestamp"), clustered=False)
    assert got == seconds(batch)
    assert any(r[3] == "STORED" for r in got) and not any(r[3] in ("UP", "UNREACHABLE") for r in got)


def written(spark, path, df):
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_fleet_state_goes_on_from_a_table(spark, tmp_path):
    """Cut in the middle: launches that are open, dead, removed and unreachable instances are carried over."""
    rows = shifted(random_events(11, 40, KINDS, hot=40, span=60))
    first, second = [r for r in rows if r[1] < START + 30], [r for r in rows if r[1] >= START + 30]
    done = ops.fleet_transitions(table(spark, first, EVENTS, "ts"), 3, F.lit("1970-01-01").cast("timestamp"))
    carry = written(spark, str(tmp_path / "carry"), ops.fleet_carry(table(spark, first, EVENTS, "ts"), 3))
    assert carry.where("dead").count() and carry.where("removed").count() and carry.where("away").count()
    assert carry.where("deadline IS NOT NULL").count()
    updates = as_stream(spark, str(tmp_path / "in"), second, EVENTS, "ts", ("~", FAR, 0, "REACHABLE"), "10 seconds", batches=2)
    rest = streaming.run_to_table(streaming.stream_fleet_state(updates, 3, initial=carry, slot=4, buckets=8), "t8")
    whole = ops.fleet_transitions(table(spark, rows, EVENTS, "ts"), 3, F.lit("2030-01-01").cast("timestamp"))
    assert sorted(seconds(done) + seconds(rest), key=str) == seconds(whole)


MEMBERS = ["UNREACHABLE", "REACHABLE", "REMOVED"]
LISTED = "instance_id string, deregistered_at double"


def test_auto_down(spark, tmp_path):
    rows = [(*r, r[2] % 5 == 0) for r in shifted(random_events(4, 25, MEMBERS, hot=20))]
    schema = EVENTS + ", exiting boolean"
    gone = [(f"k{k}", START + random.Random(k).randint(0, 30)) for k in range(0, 25, 2)]
    events = as_stream(spark, str(tmp_path / "e"), rows, schema, "ts", ("~", FAR, 0, "REACHABLE", None), "10 seconds")
    listed = as_stream(spark, str(tmp_path / "d"), gone, LISTED, "deregistered_at", ("~", FAR), "10 seconds", batches=2)
    got = seconds(streaming.run_to_table(streaming.stream_auto_down(events, listed, 1.5, slot=4, buckets=8), "t2"))
    never = [(f"k{k}", None) for k in range(1, 25, 2)]
    batch = ops.auto_down(table(spark, rows, schema, "ts"), table(spark, gone + never, LISTED, "deregistered_at"), 1.5)
    assert got == seconds(batch.where("down_at is not null").drop("ended_at"))
    assert {r[3] for r in got} == {"DOWNED", "EXITING"}


def test_auto_down_goes_on_from_a_table(spark, tmp_path):
    rows = shifted(random_events(12, 40, MEMBERS))
    gone = [(f"k{k}", START + random.Random(k).randint(0, 30)) for k in range(0, 40, 2)]
    middle = START + 15
    early = [r for r in rows if r[1] < middle], [g for g in gone if g[1] < middle]
    late = [r for r in rows if r[1] >= middle], [g for g in gone if g[1] >= middle]
    tables = table(spark, early[0], EVENTS, "ts"), table(spark, early[1] + [(g[0], None) for g in late[1]], LISTED, "deregistered_at")
    never = [(f"k{k}", None) for k in range(1, 40, 2)]
    tables = tables[0], tables[1].unionByName(table(spark, never, LISTED, "deregistered_at"))
    done = ops.auto_down(*tables, 1.5).where("ended_at is not null and down_at is not null")
    carry = written(spark, str(tmp_path / "carry"), ops.auto_down_carry(*tables))
    events = as_stream(spark, str(tmp_path / "e"), late[0], EVENTS, "ts", ("~", FAR, 0, "REACHABLE"), "10 seconds", batches=2)
    listed = as_stream(spark, str(tmp_path / "d"), late[1], LISTED, "deregistered_at", ("~", FAR), "10 seconds", batches=2)
    rest = streaming.run_to_table(streaming.stream_auto_down(events, listed, 1.5, carry, slot=4, buckets=8), "t9")
    whole = ops.auto_down(table(spark, rows, EVENTS, "ts"), table(spark, gone + never, LISTED, "deregistered_at"), 1.5)
    columns = ["instance_id", "unreachable_at", "down_at"]
    got = seconds(done.select(columns)) + seconds(rest.select(columns))
    assert sorted(got, key=str) == seconds(whole.where("down_at is not null").select(columns))


BEATS = "key string, ts double"
SUMS = ["sum(beats) AS beats", "sum(missed) AS missed", "max(terminated_at) AS t", "sum(late_beats) AS late"]


@pytest.mark.parametrize("clock", [None, "stream", "table"])
def test_heartbeat(spark, tmp_path, clock):
    """With a start clock, keys k20 to k29 never send a beat and end as well."""
    rng = random.Random(5)
    rows = [(f"k{k}", START + 8 + rng.randint(0, 120) / 2) for k in range(20) for _ in range(rng.randint(1, 20))]
    begin = [(f"k{k}", START + rng.randint(0, 10) / 2) for k in range(30)]
    beats = as_stream(spark, str(tmp_path / "b"), rows, BEATS, "ts", ("~", FAR), "10 seconds")
    starts = initial = None
    if clock == "stream":
        starts = as_stream(spark, str(tmp_path / "s"), begin, BEATS, "ts", ("~", FAR), "10 seconds", batches=1)
    if clock == "table":
        initial = written(spark, str(tmp_path / "i"), table(spark, begin, BEATS, "ts"))
    found = streaming.stream_heartbeat(beats, 1.5, 2, starts, initial, buckets=8)
    got = seconds(streaming.run_to_table(found, "t3").where("key != '~'").groupBy("key").agg(*map(F.expr, SUMS)))
    first = table(spark, begin, BEATS, "ts") if clock else None
    batch = ops.heartbeat_liveness(table(spark, rows, BEATS, "ts"), 1.5, 2, F.lit("2030-01-01").cast("timestamp"), first)
    assert got == seconds(batch.select("key", "beats", "missed", "terminated_at", "late_beats"))
    assert len(got) == (30 if clock else 20)


def test_outage(spark, tmp_path):
    rng = random.Random(6)
    schema = "key string, ts double, event_id bigint, is_down boolean"
    rows = [(f"k{k}", START + rng.randint(0, 60), i * 100 + k, rng.random() < 0.6) for k in range(20) for i in range(rng.randint(1, 12))]
    events = as_stream(spark, str(tmp_path), rows, schema, "ts", ("~", FAR, 0, False), "10 seconds")
    got = seconds(streaming.run_to_table(streaming.stream_outage(events, 2), "t4"))
    assert got == seconds(ops.outage_terminations(table(spark, rows, schema, "ts"), 2, F.lit("2030-01-01").cast("timestamp")))


ASKED, ANSWERS = "request_id string, ts double", "request_id string, response_id string, ts double"


def logs(spark, path, seed):
    """Ids that are asked again, and answers that come early, late, twice or to nobody."""
    rng = random.Random(seed)
    asked = [(f"r{rng.randint(0, 25)}", START + rng.randint(0, 60)) for _ in range(80)]
    answers = [(f"r{rng.randint(0, 30)}", f"a{i}", START + rng.randint(0, 90)) for i in range(120)]
    requests = as_stream(spark, str(path / "q"), asked, ASKED, "ts", ("~", FAR), "10 seconds")
    responses = as_stream(spark, str(path / "p"), answers, ANSWERS, "ts", ("~~", "", FAR), "10 seconds")
    return asked, answers, requests, responses


def test_correlate_is_the_batch_form(spark, tmp_path):
    asked, answers, requests, responses = logs(spark, tmp_path, 7)
    found = streaming.stream_correlate(requests, responses, 8, give_up=1000, slot=4, buckets=4)
    got = streaming.run_to_table(found, "t5").where("request_id not like '~%'")
    done, orphans = folds.senders(asked, answers, 8)
    assert seconds(got.where("outcome != 'ORPHAN'").drop("message")) == done
    assert seconds(got.where("outcome = 'ORPHAN'").select("request_id", "response_id", "answered_at", "message")) == orphans


def test_correlate_gives_up_at_the_deadline(spark, tmp_path):
    """By default a request is dropped at its deadline, and answers after that have no sender."""
    asked, answers, requests, responses = logs(spark, tmp_path, 8)
    got = streaming.run_to_table(streaming.stream_correlate(requests, responses, 8, slot=4), "t10").where("request_id not like '~%'")
    done, orphans = folds.senders(asked, answers, 8, give_up=8)
    assert seconds(got.where("outcome != 'ORPHAN'").drop("message")) == done
    assert seconds(got.where("outcome = 'ORPHAN'").select("request_id", "response_id", "answered_at", "message")) == orphans
    assert {r[2] for r in done} == {"ANSWERED", "TIMED_OUT", "SUPERSEDED"}


@pytest.mark.parametrize("ids, give_up", [(2000, None), (500, 1000)])
def test_state_is_kept_by_bucket_and_not_by_event(spark, tmp_path, ids, give_up):
    """Two thousand requests, each in a slot of its own, in four buckets."""
    asked = [(f"q{k % ids}", START + 10.0 * k) for k in range(2000)]
    requests = as_stream(spark, str(tmp_path / "q"), asked, "request_id string, ts double", "ts", ("~", FAR), "10 seconds", batches=1)
    responses = as_stream(
        spark, str(tmp_path / "p"), [(f"q{k % ids}", f"p{k}", START + 10.0 * k + 1) for k in range(2000)],
        "request_id string, response_id string, ts double", "ts", ("~~", None, FAR), "10 seconds", batches=1,
    )
    found = streaming.stream_correlate(requests, responses, 8, give_up=give_up, slot=4, buckets=4)
    query = found.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    operators = [o for p in query.recentProgress for o in json.loads(p.json)["stateOperators"]]
    assert 0 < sum(o["numRowsUpdated"] for o in operators) < 200


def state_rows(stream, checkpoint):
    query = stream.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(o["numRowsUpdated"] for p in query.recentProgress for o in json.loads(p.json)["stateOperators"])


def test_registration_keeps_state_by_bucket(spark, tmp_path):
    rows = [(f"i{k % 900}", START + 10.0 * k, k) for k in range(2000)]
    schema = "instance_id string, ts double, event_id bigint"
    new = as_stream(spark, str(tmp_path / "in"), rows, schema, "ts", ("~", FAR, 0), "10 seconds", batches=1)
    assert 0 < state_rows(streaming.stream_register(new, None, ["event_id"], slot=4, buckets=4), str(tmp_path / "c")) < 200


def test_fleet_state_is_kept_by_bucket(spark, tmp_path):
    rows = [(f"i{k % 900}", START + 10.0 * k, k, "UP") for k in range(2000)]
    updates = as_stream(spark, str(tmp_path / "in"), rows, EVENTS, "ts", ("~", FAR, 0, "REACHABLE"), "10 seconds", batches=1)
    assert 0 < state_rows(streaming.stream_fleet_state(updates, 3, slot=4, buckets=4), str(tmp_path / "c")) < 200


@pytest.mark.parametrize("forget", [None, 12])
def test_register(spark, tmp_path, forget):
    """The earliest record of an id by event time wins, whatever file it comes in."""
    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 9)}", START + rng.randint(0, 40), i, {"n": i}) for i in range(80)]
    schema = "instance_id string, ts double, event_id bigint, extra map<string,int>"
    held = written(spark, str(tmp_path / "reg"), spark.createDataFrame([("k3",)], "instance_id string"))
    new = as_stream(spark, str(tmp_path / "in"), rows, schema, "ts", ("~", FAR, 0, None), "60 seconds", late=50.0)
    stream = streaming.stream_register(new, held, ["event_id"], forget, slot=4, buckets=4)
    got = seconds(streaming.run_to_table(stream, "t6").where("instance_id != '~'").withColumn("extra", F.col("extra.n")))
    until, want = {"k3": FAR}, []
    for key, ts, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        fresh = key not in until or ts > until[key]
        if fresh:
            until[key] = FAR if forget is None else ts + forget
        want.append((key, ts, i, i, "REGISTERED" if fresh else "ALREADY_EXISTS"))
    assert got == sorted(want, key=str)


def test_upsert_in_batches(spark, tmp_path):
    rows = random_events(8, 20, KINDS, hot=30)
    updates = as_stream(spark, str(tmp_path / "in"), rows, EVENTS, "ts", ("~", FAR, 0, "UP"), "1 hour")
    writer = sources.upsert_registry(updates, str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    got = seconds(sources.read_registry(spark, str(tmp_path / "out")).where("instance_id != '~'"))
    assert got == seconds(ops.last_by_key(table(spark, rows, EVENTS, "ts"), "instance_id", ["ts", "event_id"]))
