"""A registry table survives a new checkpoint."""

from fleetroll.sources.registry_table import compact_registry, read_registry, upsert_registry


def test_new_checkpoint_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "registry")
    schema = "instance_id string, ts bigint, event_id bigint"
    for k, name in enumerate("abc"):
        source = str(tmp_path / f"in-{name}")
        spark.createDataFrame([(name, k, k)], schema).write.parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        writer = upsert_registry(stream, path).option("checkpointLocation", str(tmp_path / f"checkpoint-{name}"))
        writer.trigger(availableNow=True).start().awaitTermination()
        if name == "b":
            assert {r[0] for r in read_registry(spark, path).collect()} == {"a", "b"}
            compact_registry(spark, path)
    assert {r[0] for r in read_registry(spark, path).collect()} == {"a", "b", "c"}
