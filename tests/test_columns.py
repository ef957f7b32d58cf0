import pytest
from pyspark.sql import functions as F

from fleetroll import operators as ops
from fleetroll.functions import join_namespace

U = "0f8fad5b-d9cb-469f-a165-70867728950e"


def column(spark, values, name="text"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_parse_ids(spark):
    texts = [f"cont-{U}", f"my-cont-{U}", f"cont-{U[:-1]}", "cont", "", None, f"cont-{U.upper()}", f"cont-{U}x", f"cont{U}"]
    got = {r["text"]: (r["container_name"], r["instance_uuid"], r["valid_id"]) for r in ops.parse_instance_ids(column(spark, texts), "text").collect()}
    assert got[f"cont-{U}"] == ("cont", U, True)
    assert got[f"my-cont-{U}"] == ("my-cont", U, True)
    assert got[f"cont-{U.upper()}"] == ("cont", U, True)
    for bad in (f"cont-{U[:-1]}", "cont", "", None, f"cont-{U}x"):
        assert got[bad] == (None, None, False)
    first = {r["text"]: r["valid_id"] for r in ops.parse_instance_ids(column(spark, texts), "text", mode="first_dash").collect()}
    assert first[f"cont-{U}"] and not first[f"my-cont-{U}"]


def test_minted_ids_round_trip(spark):
    df = spark.range(100).withColumn("name", F.lit("my-cont"))
    for minted in (ops.mint_instance_ids(df, "name", ["id"]), ops.mint_instance_ids(df, "name", random=True)):
        parsed = ops.parse_instance_ids(minted, "instance_id").where("valid_id and container_name = 'my-cont'")
        assert parsed.select("instance_uuid").distinct().count() == 100


def test_request_ids(spark):
    df = spark.createDataFrame([(1, "given"), (2, None)], "seq int, request_id string")
    got = {r["seq"]: r["request_id"] for r in ops.ensure_request_ids(df, "seq").collect()}
    assert got[1] == "given" and len(got[2]) == 36
    assert len({r["seq"]: r["request_id"] for r in ops.ensure_request_ids(df).collect()}[2]) == 36


def test_paths(spark):
    paths = [f"/c/c-{U}", f"c/c-{U} ", f"c-{U}"]
    got = [(r["path"], r["instance_id"], r["valid_id"]) for r in ops.ids_from_paths(column(spark, paths), "text").collect()]
    assert got == [(f"/c/c-{U}", f"c-{U}", True)] * 2 + [(f"/c-{U}", f"c-{U}", True)]


@pytest.mark.parametrize(
    "parent, child, want", [("root", "", "root"), ("root", "instance", "root/instance"), ("root/", "instance", "root/instance")]
)
def test_namespaces(spark, parent, child, want):
    df = spark.createDataFrame([(parent, child)], "p string, c string")
    assert df.select(join_namespace(F.col("p"), F.col("c"))).first()[0] == want


def test_uris(spark):
    cases = {
        "./local/path/to.jar": "file:///base/./local/path/to.jar",
        "local/path/to.jar": "file:///base/local/path/to.jar",
        "/absolute/path/to.jar": "file:///absolute/path/to.jar",
        "file:///absolute/path/to.jar": "file:///absolute/path/to.jar",
        "hdfs:///absolute/path/to.jar": "hdfs:///absolute/path/to.jar",
    }
    got = {r["text"]: (r["uri"], r["file_name"]) for r in ops.qualify_uris(column(spark, list(cases)), "text", "/base").collect()}
    assert got == {k: (v, "to.jar") for k, v in cases.items()}


def test_outcome_codes(spark):
    outcomes = ["FOUND", "LIST", "TERMINATED", "SUBMITTED", "NOT_FOUND", "BAD_ID", "FAILED", "WHATEVER", None]
    got = [r["code"] for r in ops.outcome_codes(column(spark, outcomes, "outcome")).collect()]
    assert got == [200, 200, 200, 202, 404, 400, 500, 500, 500]


def test_flatten_and_render(spark):
    df = spark.createDataFrame(
        [((("x", None), 7, {"p.q": "v"}),)],
        "settings struct<a:struct<b:string,c:string>,n:int,m:map<string,string>>",
    )
    flat = ops.flatten_properties(df, "settings")
    assert flat.first()["properties"] == {"a.b": "x", "n": "7", "m.p.q": "v"}
    assert ops.render_properties(flat, "properties").first()["rendered"] == ["-Da.b=x", "-Dm.p.q=v", "-Dn=7"]


def test_overrides_accept_nulls(spark):
    df = spark.createDataFrame(
        [(["b"], {"k": "1"}, None, None), (None, None, ["a"], {"k": "2"})],
        "jvm_args array<string>, jvm_properties map<string,string>, request_jvm_args array<string>, request_properties map<string,string>",
    )
    got = [(r["jvm_args"], r["jvm_properties"]) for r in ops.apply_overrides(df).collect()]
    assert got == [(["b"], {"k": "1"}), (["a"], {"k": "2"})]
