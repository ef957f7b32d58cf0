import pytest
from pyspark.sql import functions as F

from fleetroll import operators as ops
from fleetroll.model import CONTAINER_DEFS
from fleetroll.operators import deploy
from fleetroll.plans import DEFAULT_SKEW, SkewPolicy, expand
from tests.helpers import SPLIT

REQUESTS = "request_id string, seq bigint, name string, quantity int, jvm_args array<string>, properties map<string,string>"
DEF = ("container", 1, 1024, [("actor", "fqn")], ["-Xmx2G"], {"property": "value", "other": "o"}, {})


@pytest.fixture
def defs(spark):
    return spark.createDataFrame([DEF], CONTAINER_DEFS)


@pytest.mark.parametrize("policy", [DEFAULT_SKEW, SPLIT])
def test_overrides_and_quantity(spark, defs, policy):
    requests = spark.createDataFrame(
        [
            ("r1", 1, "container", 2, ["-Xms1G"], {"property": "other_value"}),
            ("r2", 2, "container", 0, None, None),
            ("r3", 3, "container", -1, None, None),
            ("r4", 4, "missing", 3, None, None),
            ("r5", 5, "container", 1, None, None),
        ],
        REQUESTS,
    )
    done = ops.expand_deploys(requests, defs, policy)
    rows = done.instances.collect()
    assert len({r["instance_id"] for r in rows}) == 3
    assert sorted((r["request_id"], r["ordinal"]) for r in rows) == [("r1", 1), ("r1", 2), ("r5", 1)]
    for r in rows:
        assert r["instance_id"].startswith("container-") and r["status"] == "DEPLOYING"
        overridden = r["request_id"] == "r1"
        assert r["jvm_args"] == (["-Xms1G", "-Xmx2G"] if overridden else ["-Xmx2G"])
        assert r["jvm_properties"] == {"property": "other_value" if overridden else "value", "other": "o"}
    assert [(r["request_id"], r["outcome"]) for r in done.unknown.collect()] == [("r4", "NOT_FOUND")]
    answers = {r["request_id"]: r["instance_ids"] for r in ops.submitted_instances(done).collect()}
    assert {k: len(v) for k, v in answers.items()} == {"r1": 2, "r2": 0, "r3": 0, "r5": 1}


def test_large_request_is_chunked(spark, defs, monkeypatch):
    monkeypatch.setattr(expand, "SPREAD_ABOVE", 1000)
    requests = spark.createDataFrame([("r", 1, "container", 25_001, None, None), ("s", 2, "container", 10_000, None, None)], REQUESTS)
    done = ops.expand_deploys(requests, defs)
    assert done.instances.select("instance_id").distinct().count() == 35_001
    parts = {(r["request_id"], r["part"]): len(r["instance_ids"]) for r in ops.submitted_instances(done).collect()}
    assert parts == {("r", 0): deploy.IDS_PER_PART, ("r", 1): deploy.IDS_PER_PART, ("r", 2): 5001, ("s", 0): 10_000}


def test_status_log(spark):
    expanded = spark.createDataFrame([("a",), ("b",)], "instance_id string")
    results = spark.createDataFrame([("a", True, None), ("b", False, "boom")], "instance_id string, ok boolean, error string")
    got = sorted(tuple(r) for r in ops.deploy_status_log(expanded, results).collect())
    assert got == [("a", 0, "DEPLOYING", None), ("a", 1, "LAUNCHING", None), ("b", 0, "DEPLOYING", None), ("b", 1, "DEPLOY_FAILED", "boom")]


@pytest.mark.parametrize("policy", [DEFAULT_SKEW, SkewPolicy(group_rows=20, probe_bytes=0)])
def test_cyclic_slots(spark, policy):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("seq"))
    got = {r["seq"]: r["slot"] for r in ops.cyclic_slots(df, ["seq"], 7, policy).collect()}
    assert got == {i: i % 7 for i in range(500)}


@pytest.mark.parametrize("policy", [DEFAULT_SKEW, SPLIT])
def test_match_offers(spark, policy):
    offers = spark.createDataFrame([(1, t) for t in range(40, 0, -1)] + [(2, 5), (3, 1)], "slot int, t int")
    pending = spark.createDataFrame([(1,), (2,), (4,)], "slot int")
    got = {tuple(r) for r in ops.match_offers(offers, pending, ["t"], policy).where("outcome = 'LAUNCHED'").collect()}
    assert got == {(1, 1, "LAUNCHED"), (2, 5, "LAUNCHED")}
    assert ops.match_offers(offers, pending, ["t"], policy).count() == 42
