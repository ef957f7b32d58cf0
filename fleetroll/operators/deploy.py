"""Deploy requests: expansion into instances, status log, slots and offers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import deterministic_uuid
from ..model import DEPLOY_FAILED, DEPLOYING, LAUNCHING, SLOT_MODULUS
from ..plans import DEFAULT_SKEW, Ordered, RunningSum, SkewPolicy, explode_ordinals, find_hot_keys, largest_count, skew_join
from .columns import apply_overrides
from .registry import get_containers

IDS_PER_PART = 10_000


class Deploys(NamedTuple):
    """Outcome of deploy requests: new instances, requests with a known container, and the others."""

    instances: DataFrame
    accepted: DataFrame
    unknown: DataFrame


def expand_deploys(requests: DataFrame, defs: DataFrame, policy: SkewPolicy = DEFAULT_SKEW) -> Deploys:
    """Deploy requests (request_id, seq, name, quantity, jvm_args, properties) against the definitions.

    ``instances`` has one DEPLOYING row per requested instance with the merged settings, ``unknown`` one NOT_FOUND row per
    request for a container without definition. Zero or negative quantity gives no instance.
    """
    asked = requests.withColumnsRenamed({"jvm_args": "request_jvm_args", "properties": "request_properties"})
    found = get_containers(asked, defs, policy)
    accepted = apply_overrides(found.where(F.col("outcome") == "FOUND"))
    largest = largest_count(requests, "quantity")
    expanded = explode_ordinals(accepted, "quantity", "ordinal", largest, ["request_id", "seq"])
    instance_id = F.concat_ws(
        "-", "name", deterministic_uuid(F.concat_ws(":", F.lit("new"), "request_id", F.col("ordinal").cast("string")))
    )
    instances = expanded.select(
        "request_id", "seq", F.col("name").alias("container_name"), "ordinal", instance_id.alias("instance_id"),
        F.lit(DEPLOYING).alias("status"), "cpus", "memory", "actors", "jvm_args", "jvm_properties", "environment",
    )
    unknown = found.where(F.col("outcome") == "NOT_FOUND").select("request_id", "seq", "name", "outcome")
    return Deploys(instances, accepted, unknown)


def submitted_instances(deploys: Deploys) -> DataFrame:
    """Submitted ids per accepted request (request_id, container_name, part, instance_ids).

    Ids come in parts of ``IDS_PER_PART`` in ordinal order, so a huge request never becomes one array in one task; a
    request up to that size has exactly the part 0, empty for a request without instances.
    """
    part = F.expr(f"cast((ordinal - 1) div {IDS_PER_PART} as int)")
    parts = (
        deploys.instances.groupBy("request_id", "container_name", part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "instance_id"))).alias("ids"))
        .select("request_id", "container_name", "part", F.transform("ids", lambda x: x["instance_id"]).alias("instance_ids"))
    )
    empty = deploys.accepted.where(F.col("quantity") <= 0).select(
        "request_id",
        F.col("name").alias("container_name"),
        F.lit(0).alias("part"),
        F.array().cast("array<string>").alias("instance_ids"),
    )
    return parts.unionByName(empty)


def deploy_status_log(expanded: DataFrame, results: DataFrame) -> DataFrame:
    """DEPLOYING rows followed by LAUNCHING or DEPLOY_FAILED per result (instance_id, ok, error)."""

    def entry(step: int, status: Column, error: Column) -> list:
        return ["instance_id", F.lit(step).alias("step"), status.alias("status"), error.alias("error")]

    submitted = expanded.select(*entry(0, F.lit(DEPLOYING), F.lit(None).cast("string")))
    outcome = F.when(F.col("ok"), LAUNCHING).otherwise(DEPLOY_FAILED)
    finished = results.select(*entry(1, outcome, F.when(~F.col("ok"), F.col("error"))))
    return submitted.unionByName(finished)


def cyclic_slots(
    requests: DataFrame, order: Sequence[str], modulus: int = SLOT_MODULUS, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Adds the ``slot`` given out in global arrival order, wrapping at ``modulus``.

    A table too large for one task is cut into order ranges that are numbered separately and shifted by the row counts
    before them.
    """
    numbered = Ordered(requests, [], order, policy).scan(_nth=RunningSum(F.lit(1))).df
    return numbered.withColumn("slot", F.pmod(F.col("_nth") - 1, F.lit(modulus)).cast("int")).drop("_nth")


def match_offers(
    offers: DataFrame, pending: DataFrame, order: Sequence[str], policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Marks each offer LAUNCHED or RELEASED: the earliest offer of a pending slot uses it up."""
    hot = find_hot_keys(offers, ["slot"], policy)
    numbered = Ordered(offers, ["slot"], order, policy, hot).scan(_nth=RunningSum(F.lit(1))).df
    slots = pending.select("slot").distinct().withColumn("_pending", F.lit(True))
    joined = skew_join(numbered, slots, ["slot"], "left", policy, hot)
    used = F.col("_pending").isNotNull() & (F.col("_nth") == 1)
    return joined.withColumn("outcome", F.when(used, "LAUNCHED").otherwise("RELEASED")).drop("_nth", "_pending")
