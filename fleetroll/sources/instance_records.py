"""Instance records as JSON documents, and failed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import instance_id_parts
from ..model import INSTANCE_DOCUMENT, UNIQUE_ADDRESS
from ..operators.columns import status_of

_CORRUPT = "_corrupt"
_PARSED = T.StructType([*INSTANCE_DOCUMENT.fields, T.StructField(_CORRUPT, T.StringType())])


def _text_set(col: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(col, F.array().cast("array<string>"))))


def read_instance_records(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """(registry rows, malformed rows) of stored documents.

    A document is malformed when it is no JSON of this shape, lacks its id or container, has an id that is not a container
    name and a uuid, or an unknown status. The malformed rows keep all input columns and get a ``message``.
    """
    doc = F.from_json(json_col, _PARSED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    # Filters are not pushed through a generator, so each text is parsed once and not once per condition.
    parsed = df.withColumn("_doc", F.explode(F.array(doc))).withColumn("_status", status_of(F.col("_doc.status")))
    broken = F.col(json_col).isNull() | F.col("_doc").isNull() | F.col(f"_doc.{_CORRUPT}").isNotNull()
    bad_status = F.concat(F.lit("Unexpected instance status "), F.coalesce("_doc.status", F.lit("null")))
    instance_id = F.col("_doc.instanceId")
    _, uuid = instance_id_parts(instance_id)
    message = (
        F.when(broken, "malformed document")
        .when(instance_id.isNull(), "missing instanceId")
        .when(uuid.isNull(), F.concat(F.lit("Unexpected instance ID "), instance_id))
        .when(F.col("_doc.containerName").isNull(), "missing containerName")
        .when(F.col("_status").isNull(), bad_status)
    )
    checked = parsed.withColumn("message", message)
    unique = F.struct(F.col("_doc.address.address").alias("address"), F.col("_doc.address.longUid").alias("long_uid"))
    address = F.when(F.col("_doc.address").isNotNull(), unique.cast(UNIQUE_ADDRESS))
    good = checked.where(F.col("message").isNull()).select(
        F.col("_doc.instanceId").alias("instance_id"),
        F.col("_doc.containerName").alias("container_name"),
        F.struct(
            F.col("_status").alias("status"),
            _text_set("_doc.roles").alias("roles"),
            address.alias("address"),
            _text_set("_doc.actors").alias("actors"),
            F.coalesce("_doc.extra", F.create_map().cast("map<string,string>")).alias("extra"),
        ).alias("info"),
    )
    bad = checked.where(F.col("message").isNotNull()).select(*df.columns, "message")
    return good, bad


def instance_document() -> Column:
    """Compact JSON text of a registry row with info."""
    address = F.when(
        F.col("info.address").isNotNull(),
        F.struct(F.col("info.address.address").alias("address"), F.col("info.address.long_uid").alias("longUid")),
    )
    return F.to_json(
        F.struct(
            F.col("instance_id").alias("instanceId"),
            F.col("info.status").alias("status"),
            F.col("container_name").alias("containerName"),
            F.col("info.roles").alias("roles"),
            address.alias("address"),
            F.col("info.actors").alias("actors"),
            F.col("info.extra").alias("extra"),
        )
    )


def write_instance_records(reg: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes one document per line below ``container_name=<name>/``.

    Rows are range-partitioned by container and id first: tasks get equal shares even when one container holds most
    instances, and each writes to few folders.
    """
    known = reg.where(F.col("info").isNotNull())
    documents = known.select("container_name", "instance_id", instance_document().alias("value"))
    spread = documents.repartitionByRange("container_name", "instance_id")
    spread.drop("instance_id").write.partitionBy("container_name").mode(mode).text(path)


def stored_documents(spark: SparkSession, path: str, containers: Sequence[str] | None = None) -> DataFrame:
    """(value, container_name) below a folder of ``write_instance_records``; of the given containers, other folders are not read.

    Container names stay texts, whatever they look like.
    """
    stored = spark.read.schema("value string, container_name string").text(path)
    return stored if containers is None else stored.where(F.col("container_name").isin(*containers))


def read_stored_instances(
    spark: SparkSession, path: str, containers: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(registry rows, malformed rows) of the given containers, by default of all."""
    return read_instance_records(stored_documents(spark, path, containers).select("value"), "value")


def lookup_stored_instances(requests: DataFrame, path: str) -> DataFrame:
    """Per request (request_id, instance_id): ``outcome`` FOUND with the info, or NOT_FOUND.

    An id names its container, so the join is on both, and Spark prunes the scan to the folders of the containers that
    requests ask for (dynamic partition pruning).
    """
    container, _ = instance_id_parts(F.col("instance_id"))
    asked = requests.withColumn("container_name", container)
    wanted = asked.select("container_name").where("container_name IS NOT NULL").distinct()
    documents = stored_documents(requests.sparkSession, path).join(wanted, "container_name", "left_semi")
    found, _ = read_instance_records(documents.select("value"), "value")
    joined = asked.join(found.select("container_name", "instance_id", "info"), ["container_name", "instance_id"], "left")
    outcome = F.when(F.col("info").isNotNull(), "FOUND").otherwise("NOT_FOUND")
    return joined.select(*requests.columns, outcome.alias("outcome"), "info")


def split_failures(df: DataFrame, failed: str = "FAILED") -> tuple[DataFrame, DataFrame]:
    """(other rows, failure rows) of an outcome table with ``request_id``, ``outcome`` and optionally ``error``.

    Failure rows are (request_id, message, stack_trace). Both are filters over the same plan and nothing is cached, so the
    input may be of any size; write it first if it is costly to compute twice.
    """
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    lines = F.split(F.coalesce(error, F.lit("operation failed")), "\n")
    is_failed = F.coalesce(F.col("outcome") == failed, F.lit(False))
    failures = df.where(is_failed).select(
        "request_id", F.element_at(lines, 1).alias("message"), F.slice(lines, 2, F.size(lines)).alias("stack_trace")
    )
    return df.where(~is_failed), failures
