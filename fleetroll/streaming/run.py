"""Running a stream over everything that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch_path

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def use_rocksdb(spark: SparkSession) -> None:
    """State that may outgrow executor memory; stateful processors need this store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def run_to_table(stream: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Processes all available input into a fresh parquet table and returns that table.

    State is spread over ``partitions``, by default the session's shuffle partitions. A stream keeps the number for
    ever: its partitions are not coalesced at run time, and each one costs a store commit in every micro-batch.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    configured = spark.conf.get(SHUFFLE_PARTITIONS)
    if partitions is None:
        partitions = int(configured)
    spark.conf.set(SHUFFLE_PARTITIONS, partitions)  # a query keeps the settings it was started with
    try:
        running = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{path}/rows")
        )
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, configured)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
