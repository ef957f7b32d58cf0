import json

from pyspark.sql import functions as F

from fleetroll import sources, streaming
from fleetroll.sources import registry_table
from tests.helpers import address, ids, instance, registry, table


def test_container_defs(spark, tmp_path):
    records = [
        {"name": "container1", "actors": [{"name": "actor1", "fqn": "com.test.Actor1"}, {"name": "actor2", "fqn": "com.test.Actor2"}], "cpus": 1, "memory": 1024, "jvm-args": ["-Xmx2G"], "properties": {"property": "value"}},
        {"name": "container2", "actors": [{"name": "actor3", "fqn": "com.test.Actor3"}], "cpus": 2, "memory": 2048, "environment": {"envProperty": "value"}},
        {"name": "twice", "cpus": 1, "memory": 1},
        {"name": "twice", "cpus": 9, "memory": 1, "jvmArgs": ["x"]},
    ]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    for name, multi_line in (("lines.json", False), ("array.json", True)):
        got = {r["name"]: r for r in sources.read_container_defs(spark, str(tmp_path / name), multi_line).collect()}
        assert len(got) == 3
        one, two = got["container1"], got["container2"]
        assert one["jvm_args"] == ["-Xmx2G"] and one["jvm_properties"] == {"property": "value"} and one["environment"] == {}
        assert [a["fqn"] for a in one["actors"]] == ["com.test.Actor1", "com.test.Actor2"]
        assert two["jvm_args"] == [] and two["jvm_properties"] == {} and two["environment"] == {"envProperty": "value"}
        assert got["twice"]["cpus"] == 9 and got["twice"]["actors"] == []


def an_id(container, n):
    return f"{container}-00000000-0000-0000-0000-{n:012d}"


def test_instance_records_round_trip(spark, tmp_path):
    x, y, z = an_id("c1", 1), an_id("c2", 2), an_id("c2", 3)
    reg = registry(spark, [instance(x, "c1", "UP", ["b", "a", "b"], address(1)), instance(y, "c2", "DEPLOYING", addr=address(2, None)), (z, "c2", None)])
    path = str(tmp_path / "records")
    sources.write_instance_records(reg, path)
    stored = spark.read.text(path)
    assert "container_name" in stored.columns
    good, bad = sources.read_instance_records(stored, "value")
    assert bad.count() == 0
    got = {r["instance_id"]: r["info"] for r in good.collect()}
    assert set(got) == {x, y}
    assert got[x]["roles"] == ["a", "b"] and got[x]["address"]["long_uid"] == 1
    assert got[y]["address"]["address"]["host"] is None and got[y]["extra"] == {}


def test_one_container_is_read_alone(spark, tmp_path):
    """Other folders are neither listed as input nor parsed; names that look like numbers stay texts."""
    rows = [instance(an_id(c, n), c, "UP") for c in ("007", "7", "c-2") for n in range(3)]
    path = str(tmp_path / "records")
    sources.write_instance_records(registry(spark, rows), path)
    good, bad = sources.read_stored_instances(spark, path, ["007"])
    assert {r["instance_id"] for r in good.collect()} == {an_id("007", n) for n in range(3)} and bad.count() == 0
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(container_name" in plan and "(container_name#" in plan and "= 007)]" in plan
    assert {f.split("/")[-2] for f in sources.stored_documents(spark, path, ["007"]).inputFiles()} >= {"container_name=007"}
    read = sources.stored_documents(spark, path, ["c-2"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("/")[-2] for r in read} == {"container_name=c-2"}
    assert sources.read_stored_instances(spark, path)[0].count() == 9
    assert sources.read_stored_instances(spark, path, ["none"])[0].count() == 0


def test_lookup_stored_instances(spark, tmp_path):
    path = str(tmp_path / "records")
    sources.write_instance_records(registry(spark, [instance(an_id("c1", 1), "c1", "UP"), instance(an_id("c2", 1), "c2", "UP")]), path)
    asked = [(1, an_id("c1", 1)), (2, an_id("c1", 2)), (3, "garbage"), (4, None), (5, an_id("c1", 1))]
    found = sources.lookup_stored_instances(spark.createDataFrame(asked, "request_id int, instance_id string"), path)
    got = {r["request_id"]: (r["outcome"], r["info"] and r["info"]["status"]) for r in found.collect()}
    assert got == {1: ("FOUND", "UP"), 2: ("NOT_FOUND", None), 3: ("NOT_FOUND", None), 4: ("NOT_FOUND", None), 5: ("FOUND", "UP")}


def test_malformed_records(spark):
    full = '{"instanceId":"%s","status":"up","containerName":"c","roles":[],"actors":[]}' % an_id("c", 1)
    rows = [(1, full), (2, "{broken"), (3, None), (4, full.replace("up", "gone")), (5, full.replace('"instanceId":"%s",' % an_id("c", 1), "")), (6, "[]"), (7, full.replace('"containerName":"c",', ""))]
    rows += [(8, full.replace(an_id("c", 1), bad)) for bad in ("garbage",)] + [(9, full.replace(an_id("c", 1), "c-0-0-0-0-0"))]
    good, bad = sources.read_instance_records(spark.createDataFrame(rows, "n int, doc string"), "doc")
    assert [(r["instance_id"], r["info"]["status"], r["info"]["address"]) for r in good.collect()] == [(an_id("c", 1), "UP", None)]
    messages = {r["n"]: r["message"] for r in bad.collect()}
    assert set(messages) == {2, 3, 4, 5, 6, 7, 8, 9}
    assert messages[4] == "Unexpected instance status gone" and messages[5] == "missing instanceId"
    assert messages[8] == "Unexpected instance ID garbage"


def test_split_failures(spark):
    df = spark.createDataFrame([("r1", "FOUND", None), ("r2", "FAILED", "boom\nat x\nat y"), ("r3", "FAILED", None), ("r4", None, None)], "request_id string, outcome string, error string")
    rest, failures = sources.split_failures(df)
    assert ids(rest, "request_id") == {"r1", "r4"}
    assert {r["request_id"]: (r["message"], r["stack_trace"]) for r in failures.collect()} == {"r2": ("boom", ["at x", "at y"]), "r3": ("operation failed", [])}


def test_registry_table_survives_retries_and_compaction(spark, tmp_path):
    path = str(tmp_path / "table")

    def batch(*rows):
        return table(spark, list(rows), "instance_id string, ts double, event_id bigint, kind string", "ts")

    def now():
        return {r["instance_id"]: r["kind"] for r in sources.read_registry(spark, path).collect()}

    registry_table.write_delta(batch(("a", 1.0, 1, "UP"), ("a", 2.0, 2, "LAUNCHING"), ("b", 1.0, 3, "UP")), 0, path)
    registry_table.write_delta(batch(("b", 0.5, 4, "LAUNCHING"), ("c", 1.0, 5, "UP")), 1, path)
    want = {"a": "LAUNCHING", "b": "UP", "c": "UP"}
    assert now() == want
    registry_table.write_delta(batch(("b", 0.5, 4, "LAUNCHING"), ("c", 1.0, 5, "UP")), 1, path)
    assert now() == want
    assert sources.compact_registry(spark, path) == 1
    assert now() == want
    registry_table.write_delta(batch(("b", 9.0, 6, "REMOVED")), 2, path)
    assert now() == {**want, "b": "REMOVED"}
    assert sources.compact_registry(spark, path) == 2 and sources.compact_registry(spark, path) == 2
    assert now() == {**want, "b": "REMOVED"}


def test_malformed_container_defs(spark, tmp_path):
    good = {"name": "a", "cpus": 1, "memory": 2}
    lines = [json.dumps(good), "{broken", json.dumps({**good, "name": None}), json.dumps({"name": "b", "memory": 1}), json.dumps({"name": "c", "cpus": 1}), json.dumps({**good, "name": "d", "cpus": "many"})]
    (tmp_path / "defs.json").write_text("\n".join(lines))
    assert ids(sources.read_container_defs(spark, str(tmp_path)), "name") == {"a"}
    got = sorted((r["message"], r["record"]) for r in sources.malformed_container_defs(spark, str(tmp_path)).collect())
    assert [m for m, _ in got] == ["malformed record", "malformed record", "missing cpus", "missing memory", "missing name"]
    assert "{broken" in {r for _, r in got}


def test_malformed_updates(spark, tmp_path):
    update = {"instance_id": "a", "ts": "2024-01-01T00:00:00Z", "event_id": 1, "kind": "UP"}
    lines = [json.dumps(update), "{broken", json.dumps({"kind": "UP"}), json.dumps({"updates": [{**update, "instance_id": "b"}, {"event_id": 7}]})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "updates.json").write_text("\n".join(lines))
    good = streaming.run_to_table(sources.stream_updates(spark, str(tmp_path / "in")), "good")
    assert ids(good) == {"a", "b"}
    bad = streaming.run_to_table(sources.malformed_updates(spark, str(tmp_path / "in")), "bad").collect()
    assert sorted(r["message"] for r in bad) == ["malformed message", "missing instance_id", "missing instance_id"]
    assert "{broken" in {r["record"] for r in bad}


def test_intermediate_tables_are_released_on_request(spark):
    one, two, never = (sources.scratch_path(spark, name) for name in ("one", "two", "never"))
    for path in (one, two):
        spark.range(3).write.parquet(path)
    assert set(sources.release_scratch(spark, keep=[two])) >= {one}
    assert spark.read.parquet(two).count() == 3
    assert sources.release_scratch(spark) == [two]  # what was never written is no error
    assert sources.release_scratch(spark) == []
