import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetroll import operators as ops
from tests.helpers import SPLIT, address, ids, instance, registry, table

FIVE = [
    instance("i1", "container1", "DEPLOYING", ["role11"]),
    instance("i2", "container1", "DEPLOYING", ["role12"]),
    instance("i3", "container2", "DEPLOYING", ["role21"]),
    instance("i4", "container2", "DEPLOYING", ["role22"]),
    instance("i5", "container2", "UP", ["role22"]),
    ("i6", "container1", None),
]

CASES = [
    ("container1", ["role11"], [], {"i1"}),
    ("container1", ["role12"], [], {"i2"}),
    ("container2", ["role21"], [], {"i3"}),
    ("container2", ["role22"], [], {"i4", "i5"}),
    ("container1", [], [], {"i1", "i2"}),
    ("container2", [], [], {"i3", "i4", "i5"}),
    ("container2", [], ["UP"], {"i5"}),
    ("container2", ["role22"], ["UP"], {"i5"}),
    ("container2", ["role22"], ["UP", "DEPLOYING"], {"i4", "i5"}),
    (None, [], ["UP"], {"i5"}),
    (None, [], ["UNREACHABLE"], set()),
    ("", [], [], {"i1", "i2", "i3", "i4", "i5"}),
    (None, ["role11", "role21"], [], {"i1", "i3"}),
]


@pytest.mark.parametrize("container, roles, statuses, want", CASES)
def test_instances_by(spark, container, roles, statuses, want):
    assert ids(ops.instances_by(registry(spark, FIVE), container, roles, statuses)) == want


def test_instances_by_all_roles(spark):
    reg = registry(spark, [instance("a", "c", "UP", ["x", "y"]), instance("b", "c", "UP", ["x"])])
    assert ids(ops.instances_by(reg, roles=["x", "y"], role_match="all")) == {"a"}
    assert ids(ops.instances_by(reg, roles=["x", "y"])) == {"a", "b"}


def test_status_text_ignores_case(spark):
    assert ids(ops.instances_by(registry(spark, FIVE), statuses=["up"])) == {"i5"}
    with pytest.raises(ValueError):
        ops.instances_by(registry(spark, FIVE), statuses=["invalid"])


@pytest.mark.parametrize("policy", [ops.registry.DEFAULT_SKEW, SPLIT])
def test_filter_requests_answer_like_single_filters(spark, policy):
    asked = [(i, c, r, s) for i, (c, r, s, _) in enumerate(CASES)]
    asked += [(100 + i, "container2", ["role22"], ["up", "nonsense"]) for i in range(20)]
    asked += [(200, None, None, None), (201, None, [], ["nonsense"])]
    requests = spark.createDataFrame(asked, "request_id int, container string, roles array<string>, statuses array<string>")
    got = {}
    for r in ops.instances_by_requests(registry(spark, FIVE), requests, policy=policy).collect():
        assert r["instance_id"] not in got.setdefault(r["request_id"], set())
        got[r["request_id"]].add(r["instance_id"])
    for i, (container, roles, statuses, want) in enumerate(CASES):
        assert got.get(i, set()) == want, CASES[i]
    for i in range(20):
        assert got[100 + i] == {"i5"}
    everything = {"i1", "i2", "i3", "i4", "i5", "i6"}
    assert got[200] == got[201] == everything


def test_filter_requests_all_roles(spark):
    reg = registry(spark, [instance("a", "c", "UP", ["x", "y"]), instance("b", "c", "UP", ["x"])])
    requests = spark.createDataFrame(
        [(1, None, ["x", "y"], [])], "request_id int, container string, roles array<string>, statuses array<string>"
    )
    assert ids(ops.instances_by_requests(reg, requests, role_match="all")) == {"a"}


def test_exclude_and_members(spark):
    assert ids(ops.exclude_container(registry(spark, FIVE), "container1")) == {"i3", "i4", "i5"}
    events = spark.createDataFrame([(1, ["master"]), (2, ["other"]), (3, None)], "id int, roles array<string>")
    assert ids(ops.members_with_role(events, "master"), "id") == {1}


@pytest.fixture
def lookups(spark):
    local = registry(spark, [instance("known", "c", "UP", addr=address(1)), ("bare", "c", None), ("lost", "c", None), ("broken", "c", None)])
    stored = registry(
        spark,
        [instance("bare", "c", "UP", addr=address(2)), instance("remote", "c", "UP", addr=address(3)), instance("broken", "c", "UP")],
    ).withColumn("error", F.when(F.col("instance_id") == "broken", "fail\nat a\nat b"))
    requests = spark.createDataFrame(
        [(1, "known", 1), (2, "bare", 2), (3, "lost", 3), (4, "remote", 4), (5, "none", 5), (6, "broken", 6)],
        "request_id int, instance_id string, seq int",
    )
    return requests, local, stored


@pytest.mark.parametrize("policy", [ops.registry.DEFAULT_SKEW, SPLIT])
def test_get_instances(lookups, policy):
    requests, local, stored = lookups
    more = requests.union(requests.where("request_id = 2").crossJoin(requests.sparkSession.range(10)).selectExpr("cast(10 + id as int)", "instance_id", "seq"))
    got = {r["request_id"]: (r["outcome"], r["source"]) for r in ops.get_instances(more, local, stored, policy=policy).collect()}
    assert len(got) == 16
    assert got[1] == ("FOUND", "LOCAL")
    assert got[2] == got[12] == ("FOUND", "STORAGE")
    assert got[3] == ("NOT_FOUND", None)
    assert got[4] == ("NOT_FOUND", None)  # not known here, and the cluster is asked first
    assert got[5] == ("NOT_FOUND", None)
    assert got[6] == ("FAILED", None)
    got = {r["request_id"]: r["outcome"] for r in ops.get_instances(requests, local, stored, clustered=False).collect()}
    assert got[4] == "FOUND" and got[5] == "NOT_FOUND"


def test_resolve_terminations(spark, lookups):
    requests, local, stored = lookups
    got = {r["request_id"]: r["outcome"] for r in ops.resolve_terminations(requests, local, stored).collect()}
    assert got == {1: "TERMINATED", 2: "TERMINATED", 3: "NOT_FOUND", 4: "NOT_FOUND", 5: "NOT_FOUND", 6: "FAILED"}
    without = stored.withColumn("error", F.lit(None).cast("string"))
    got = {r["request_id"]: r["outcome"] for r in ops.resolve_terminations(requests, local, without, clustered=False).collect()}
    assert got[4] == "TERMINATED" and got[6] == "FAILED"  # found, but without an address
    twice = spark.createDataFrame([(1, "bare", 1), (2, "bare", 2)], requests.schema)
    got = {r["request_id"]: r["outcome"] for r in ops.resolve_terminations(twice, local, stored).collect()}
    assert got == {1: "SUPERSEDED", 2: "TERMINATED"}


def test_get_containers(spark):
    defs = spark.createDataFrame([("c1", 1)], "name string, cpus int")
    requests = spark.createDataFrame([(1, "c1"), (2, "c2")], "request_id int, name string")
    got = {r["request_id"]: (r["outcome"], r["cpus"]) for r in ops.get_containers(requests, defs).collect()}
    assert got == {1: ("FOUND", 1), 2: ("NOT_FOUND", None)}


@pytest.mark.parametrize("policy", [ops.registry.DEFAULT_SKEW, SPLIT])
def test_register_if_absent(spark, policy):
    new = spark.createDataFrame([(i, "a") for i in range(50, 0, -1)] + [(60, "b"), (61, "c"), (62, "c")], "seq int, instance_id string")
    reg = registry(spark, [("b", "c", None)])
    got = {r["seq"]: r["outcome"] for r in ops.register_if_absent(new, reg, ["seq"], policy).collect()}
    assert len(got) == 53
    assert {s for s, o in got.items() if o == "REGISTERED"} == {1, 61}


def test_lists(spark):
    reg = registry(spark, FIVE)
    assert ids(ops.list_instances(reg)) == {"i1", "i2", "i3", "i4", "i5", "i6"}
    names = spark.createDataFrame([("container1",), ("container3",)], "name string")
    got = {tuple(r) for r in ops.list_instances(reg, by_container=True, containers=names).collect()}
    assert got == {("container1", "i1"), ("container1", "i2"), ("container1", "i6"), ("container3", None)}
    assert ids(ops.list_containers(names.union(names)), "name") == {"container1", "container3"}


def test_last_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert {tuple(r) for r in ops.last_by_key(df, "k", ["n"]).collect()} == {("a", 2, "y"), ("b", 1, "z")}


def test_known_instances(spark):
    local = registry(spark, [instance("a", "c", "UP"), ("b", "c", None)])
    stored = registry(spark, [instance("d", "c", "UP"), instance("a", "c", "UP")])
    assert ids(ops.known_instances(local, stored)) == {"a", "b"}
    assert ids(ops.known_instances(local, stored, clustered=False)) == {"a", "d"}


def test_hybrid(spark):
    full = registry(spark, [instance("a", "c", "UP"), instance("b", "c", "LAUNCHING")])
    part = full.union(registry(spark, [("x", "c", None)]))
    stored = registry(spark, [instance("d", "c", "UP"), instance("e", "k", "UP")])
    assert ids(ops.instances_by_hybrid(full, stored, statuses=["UP"])) == {"a"}
    assert ids(ops.instances_by_hybrid(part, stored, statuses=["UP"])) == {"a", "d", "e"}
    assert ids(ops.instances_by_hybrid(full, stored, statuses=["UP"], clustered=False)) == {"a", "d", "e"}
    assert ids(ops.instances_by_hybrid(part, stored, container="c")) == {"a", "b", "d"}
    assert ids(ops.instances_by_hybrid(full.limit(0), stored, container="c")) == set()


def test_reconcile_snapshot(spark):
    one, two = registry(spark, [instance("id1", "c", "UP")]), registry(spark, [instance("id2", "c", "UP")])
    assert {tuple(r) for r in ops.reconcile_snapshot(one, two).collect()} == {("id1", "DROPPED", True), ("id2", "ADDED", True)}
    assert {tuple(r) for r in ops.reconcile_snapshot(one, one).collect()} == {("id1", "KEPT", False)}
    assert {tuple(r) for r in ops.reconcile_snapshot(one, two.limit(0)).collect()} == {("id1", "DROPPED", False)}
    assert ops.reconcile_snapshot(one.limit(0), two).collect() == []


def test_seed_nodes(spark):
    reg = registry(spark, [instance(f"i{n}", "c" if n else "master", "UP", addr=address(n)) for n in range(6)] + [instance("i0a", "c", "LAUNCHING")])
    assert ids(ops.seed_nodes(reg, 3, "master")) == {"i1", "i2", "i3"}
    assert ids(ops.seed_nodes(reg, 30, "master")) == {"i1", "i2", "i3", "i4", "i5"}
    assert ids(ops.seed_nodes(reg, 1, per="container_name")) == {"i0", "i1"}


def test_match_members(spark):
    reg = registry(
        spark,
        [instance("b", "c", "UP", addr=address(1)), instance("a", "c", "UP", addr=address(1)), instance("n", "c", "UP", addr=address(2, None)), instance("x", "c", "LAUNCHING")],
    )
    events = spark.createDataFrame(
        [(1, address(1)), (2, address(2, None)), (3, address(3)), (4, address(2)), (5, None)],
        "event_id int, address struct<address:struct<protocol:string,system:string,host:string,port:int>,long_uid:bigint>",
    )
    matched, unknown = ops.match_members(events, reg)
    assert {(r["event_id"], r["instance_id"]) for r in matched.collect()} == {(1, "a"), (2, "n")}
    assert ids(unknown, "event_id") == {3, 4, 5}


def test_strict_status(spark):
    df = table(spark, [("up",), ("bad",), (None,)], "s string")
    assert {tuple(r) for r in ops.parse_statuses(df, "s").collect()} == {("up", "UP"), ("bad", None), (None, None)}
    with pytest.raises(PySparkException, match="Unexpected instance status bad"):
        ops.parse_statuses(df, "s", strict=True).collect()


def test_lookups_read_no_more_than_was_asked(spark, tmp_path):
    """Both tables are cut to the requested ids first; nothing is aggregated but requests."""
    rows = [instance(f"c-{n}", "c", "UP", addr=address(n)) for n in range(20)]
    registry(spark, rows).write.parquet(str(tmp_path / "local"))
    registry(spark, rows).write.parquet(str(tmp_path / "stored"))
    local, stored = spark.read.parquet(str(tmp_path / "local")), spark.read.parquet(str(tmp_path / "stored"))
    spark.createDataFrame([(1, "c-1", 1), (2, "c-99", 2)], "request_id int, instance_id string, seq int").write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    for found in (ops.get_instances(asked, local, stored), ops.resolve_terminations(asked, local, stored)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftSemi") == 2
        assert not any("local_info" in line for line in plan.splitlines() if "Aggregate" in line)
        aggregates = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "SortAggregate(" in line]
        assert all("last_request" in line or "partial_max(struct(seq" in line for line in aggregates)  # of requests only


def test_filter_requests_run_nothing_while_the_plan_is_built(spark, tmp_path):
    schema = "request_id int, container string, roles array<string>, statuses array<string>"
    asked = [(1, "container2", ["role22"], ["up"]), (2, None, None, None), (3, None, ["role11", "role22"], [])]
    registry(spark, FIVE).write.parquet(str(tmp_path / "reg"))
    spark.createDataFrame(asked, schema).write.parquet(str(tmp_path / "asked"))
    reg, asked = (spark.read.parquet(str(tmp_path / name)) for name in ("reg", "asked"))
    group = "built"
    spark.sparkContext.setJobGroup(group, "building")
    try:
        found = ops.instances_by_requests(reg, asked)
        none = ops.instances_by_requests(reg, asked.where("request_id > 9"))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r[0], r[1]) for r in found.collect()) == sorted(
        [(1, "i5"), *[(2, r[0]) for r in FIVE], (3, "i1"), (3, "i4"), (3, "i5")]
    )
    assert none.count() == 0 and none.columns == ["request_id", "instance_id"]
