"""Lookups, filters and set operations over the instance registry.

A registry is a table (instance_id, container_name, info) with one row per id; ``info`` null means that only the id is
known. A storage table has the same columns, optionally with ``error`` (text of a failed lookup).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import STATUSES
from ..plans import DEFAULT_SKEW, Ordered, RunningSum, SkewPolicy, find_hot_keys, skew_join, skew_join_both
from .columns import status_of


# -- filters ---------------------------------------------------------------------------------------------------------


def _role_match(roles: Column, wanted: Column, role_match: str) -> Column:
    if role_match == "any":
        return F.coalesce(F.arrays_overlap(roles, wanted), F.lit(False))
    if role_match == "all":
        return F.coalesce(F.size(F.array_except(wanted, roles)) == 0, F.lit(False))
    raise ValueError(f"unknown role_match {role_match!r}")


def instances_by(
    reg: DataFrame,
    container: str | None = None,
    roles: Sequence[str] = (),
    statuses: Sequence[str] = (),
    role_match: str = "any",
) -> DataFrame:
    """Instances that pass all given filters; an empty filter passes everything, unknown info never matches."""
    found = reg.where(F.col("info").isNotNull())
    if container:
        found = found.where(F.col("container_name") == container)
    if statuses:
        wanted = sorted({s.upper() for s in statuses})
        unknown = [s for s in wanted if s not in STATUSES]
        if unknown:
            raise ValueError(f"unknown statuses {unknown}")
        found = found.where(F.col("info.status").isin(*wanted))
    if roles:
        found = found.where(_role_match(F.col("info.roles"), F.array(*[F.lit(r) for r in sorted(set(roles))]), role_match))
    return found


_QUESTION = ["container", "roles", "statuses", "everything"]


def instances_by_requests(
    reg: DataFrame, requests: DataFrame, role_match: str = "any", policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """One answer set per filter request (request_id, container, roles, statuses): rows (request_id, instance_id).

    Bad status texts are dropped; a request left without any filter lists everything, unknown info included (an empty
    container name is a filter that all known instances pass). Requests that ask the same are answered once, and the answer is
    repeated for each; ``filter_answers`` keeps it single.
    """
    wanted, answers = _answered(reg, requests, role_match, policy)
    return skew_join_both(answers, wanted, _QUESTION, policy).select("request_id", "instance_id")


def filter_answers(
    reg: DataFrame, requests: DataFrame, role_match: str = "any", policy: SkewPolicy = DEFAULT_SKEW
) -> tuple[DataFrame, DataFrame]:
    """(request_id, asked_first) and (asked_first, instance_id): many requests with few different filters share their answers.

    ``asked_first`` is the smallest request id with the same filter. Request ids must not be null.
    """
    wanted, answers = _answered(reg, requests, role_match, policy)
    first = wanted.groupBy(*_QUESTION).agg(F.min("request_id").alias("asked_first"))
    shared = wanted.join(first, _QUESTION).select("request_id", "asked_first")
    return shared, answers.join(first, _QUESTION).select("asked_first", "instance_id")


def _answered(
    reg: DataFrame, requests: DataFrame, role_match: str, policy: SkewPolicy
) -> tuple[DataFrame, DataFrame]:
    """The requests in canonical form, and the instances of every different filter in them.

    Every filter becomes equality on up to three fields, so this is an equi-join on probe keys and never a nested loop; only
    the filter shapes in use (at most nine) make the registry side wider.
    """
    if role_match not in ("any", "all"):
        raise ValueError(f"unknown role_match {role_match!r}")
    none = F.array().cast("array<string>")

    def text_set(values: Column) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(values)))

    wanted = requests.select(
        "request_id",
        F.coalesce("container", F.lit("")).alias("container"),
        text_set(F.coalesce("roles", none)).alias("roles"),
        text_set(F.transform(F.coalesce("statuses", none), lambda s: status_of(s))).alias("statuses"),
        F.col("container").isNull().alias("everything"),
    ).withColumn("everything", F.col("everything") & (F.size("roles") == 0) & (F.size("statuses") == 0))
    by_container, by_role, by_status = F.col("container") != "", F.size("roles") > 0, F.size("statuses") > 0
    filters = wanted.select(*_QUESTION).distinct()
    # At most nine, as a scalar subquery of the plan: nothing runs while it is built.
    shape = F.struct(by_container.alias("c"), by_role.alias("r"), by_status.alias("s"), F.col("everything").alias("e"))
    shapes = filters.select(F.collect_set(shape)).scalar()

    # A probe key spells out the filtered fields, has a star for the others, and a plus to list everything.
    star = F.array(F.lit("*"))

    def one(value: Column) -> Column:
        return F.concat(F.lit("="), value)

    def each(values: Column) -> Column:
        return F.transform(values, one)

    def probe() -> Column:
        return F.concat_ws("\u0001", "p_container", "p_role", "p_status").alias("probe")

    # With "all" one role finds the candidates and the rest is checked on them.
    searched = F.col("roles") if role_match == "any" else F.slice("roles", 1, 1)
    probes = (
        filters.withColumn(
            "p_container", F.when(F.col("everything"), "+").when(by_container, one(F.col("container"))).otherwise("*")
        )
        .withColumn("p_role", F.explode(F.when(by_role, each(searched)).otherwise(star)))
        .withColumn("p_status", F.explode(F.when(by_status, each(F.col("statuses"))).otherwise(star)))
        .select(*_QUESTION, probe())
    )
    entries = (
        reg.select(
            "instance_id",
            F.col("container_name").alias("container"),
            F.col("info.status").alias("status"),
            F.coalesce("info.roles", none).alias("has_roles"),
            F.col("info").isNotNull().alias("known"),
        )
        .withColumn("shape", F.explode(shapes))
        .where(F.col("known") | F.col("shape.e"))
        .withColumn(
            "p_container", F.when(F.col("shape.e"), "+").when(F.col("shape.c"), one(F.col("container"))).otherwise("*")
        )
        .withColumn("p_role", F.explode(F.when(F.col("shape.r"), each(F.array_distinct("has_roles"))).otherwise(star)))
        .withColumn("p_status", F.when(F.col("shape.s"), one(F.col("status"))).otherwise("*"))
        .where(F.col("p_container").isNotNull() & F.col("p_role").isNotNull() & F.col("p_status").isNotNull())
        .select("instance_id", "has_roles", "p_role", probe())
    )
    hits = skew_join_both(entries, probes, ["probe"], policy)
    if role_match == "any":
        # An instance that meets several wanted roles is reported by the first of them only.
        first = F.array_min(F.array_intersect("has_roles", "roles"))
        hits = hits.where((F.size("roles") == 0) | (F.col("p_role") == one(first)))
    else:
        hits = hits.where(_role_match(F.col("has_roles"), F.col("roles"), "all"))
    return wanted, hits.select(*_QUESTION, "instance_id")


def exclude_container(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("container_name") != name)


def members_with_role(df: DataFrame, role: str, roles: str = "roles") -> DataFrame:
    return df.where(F.array_contains(roles, role))


# -- lookups ---------------------------------------------------------------------------------------------------------


def _with_error(storage: DataFrame) -> DataFrame:
    return storage if "error" in storage.columns else storage.withColumn("error", F.lit(None).cast("string"))


def _asked(ids: DataFrame, reg: DataFrame, storage: DataFrame, kept: Callable[[Column], Column]) -> DataFrame:
    """One row per requested id that either table knows, with what ``kept`` takes of the infos, and the storage's error.

    ``ids`` are the distinct requested ids. Both tables are cut down to them by semi joins before anything else, so a few
    requests cost a scan of the id columns, not an aggregation of both tables, and Catalyst broadcasts the ids when they are
    small. Ids are unique in each table, so the two meet in a join.
    """
    local = reg.select("instance_id", F.lit(True).alias("is_local"), kept(F.col("info")).alias("local_info"))
    stored = _with_error(storage).select("instance_id", F.lit(True).alias("in_storage"), kept(F.col("info")).alias("stored_info"), "error")
    local = local.join(ids, "instance_id", "left_semi")
    stored = stored.join(ids, "instance_id", "left_semi")
    return local.join(stored, "instance_id", "full")


def get_instances(
    requests: DataFrame, reg: DataFrame, storage: DataFrame, clustered: bool = True, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Per request (request_id, instance_id): ``outcome`` FOUND, NOT_FOUND or FAILED, the info and where it came from.

    Ids known without info are looked up in the storage; ids unknown locally only when not ``clustered``.
    """
    ids = requests.select("instance_id").distinct()
    known = skew_join(requests, _asked(ids, reg, storage, lambda info: info), ["instance_id"], "left", policy)
    is_local = F.coalesce("is_local", F.lit(False))
    ask_storage = is_local | F.lit(not clustered)
    outcome = (
        F.when(F.col("local_info").isNotNull(), "FOUND")
        .when(~ask_storage, "NOT_FOUND")
        .when(F.col("error").isNotNull(), "FAILED")
        .when(F.col("stored_info").isNotNull(), "FOUND")
        .otherwise("NOT_FOUND")
    )
    return known.select(
        *requests.columns,
        outcome.alias("outcome"),
        F.when(F.col("local_info").isNotNull(), "LOCAL").when(outcome == "FOUND", "STORAGE").alias("source"),
        F.when(outcome == "FOUND", F.coalesce("local_info", "stored_info")).alias("info"),
        F.when(outcome == "FAILED", F.col("error")).alias("error"),
    )


def resolve_terminations(
    requests: DataFrame, reg: DataFrame, storage: DataFrame, clustered: bool = True, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Per request (request_id, instance_id, seq): TERMINATED, NOT_FOUND, FAILED or SUPERSEDED.

    An instance with a local address ends at once. Otherwise the storage decides, and of several requests waiting for the
    same id only the last one is answered with the termination. Of the infos only whether there is an address is read.
    """
    last = requests.groupBy("instance_id").agg(F.max(F.struct("seq", "request_id")).alias("last_request"))
    # True with an address, false without one, null where nothing is known of the instance.
    state = _asked(last.select("instance_id"), reg, storage, lambda info: F.when(info.isNotNull(), info["address"].isNotNull()))
    asked = skew_join(requests, last.join(state, "instance_id", "left"), ["instance_id"], "left", policy)
    ask_storage = F.coalesce("is_local", F.lit(False)) | F.lit(not clustered)
    is_last = F.col("last_request") == F.struct("seq", "request_id")
    outcome = (
        F.when(F.col("local_info"), "TERMINATED")
        .when(~ask_storage, "NOT_FOUND")
        .when(F.col("error").isNotNull(), "FAILED")
        .when(F.col("stored_info").isNull(), "NOT_FOUND")
        .when(~F.col("stored_info"), "FAILED")
        .when(is_last, "TERMINATED")
        .otherwise("SUPERSEDED")
    )
    return asked.select(*requests.columns, outcome.alias("outcome"))


def get_containers(requests: DataFrame, defs: DataFrame, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Per request (request_id, name): FOUND with the definition columns, or NOT_FOUND.

    The definitions are broadcast when Catalyst measures them small enough, else joined by shuffle.
    """
    marked = defs.withColumn("_found", F.lit(True))
    joined = skew_join(requests, marked, ["name"], "left", policy)
    return joined.withColumn("outcome", F.when(F.col("_found"), "FOUND").otherwise("NOT_FOUND")).drop("_found")


def register_if_absent(
    new: DataFrame, reg: DataFrame, order: Sequence[str], policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Marks each new record REGISTERED or ALREADY_EXISTS: the first of an id that the registry does not hold wins."""
    hot = find_hot_keys(new, ["instance_id"], policy)
    numbered = Ordered(new, ["instance_id"], order, policy, hot).scan(_nth=RunningSum(F.lit(1))).df
    present = reg.select("instance_id").distinct().withColumn("_present", F.lit(True))
    joined = skew_join(numbered, present, ["instance_id"], "left", policy, hot)
    fresh = F.col("_present").isNull() & (F.col("_nth") == 1)
    return joined.withColumn("outcome", F.when(fresh, "REGISTERED").otherwise("ALREADY_EXISTS")).drop("_nth", "_present")


# -- lists and sets --------------------------------------------------------------------------------------------------


def list_instances(
    reg: DataFrame, by_container: bool = False, containers: DataFrame | None = None, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Distinct ids, as rows so that no container's list has to fit into one task.

    With ``by_container`` the rows are (container_name, instance_id); a container of ``containers`` (column ``name``)
    without instances has one row with a null id, and only the given containers are listed.
    """
    if not by_container:
        return reg.select("instance_id").distinct()
    ids = reg.select("container_name", "instance_id").distinct()
    if containers is None:
        return ids
    names = containers.select(F.col("name").alias("container_name")).distinct()
    listed = skew_join(ids, names, ["container_name"], "left_semi", policy)
    used = reg.select("container_name").distinct()
    empty = names.join(used, "container_name", "left_anti").withColumn("instance_id", F.lit(None).cast("string"))
    return listed.unionByName(empty)


def list_containers(defs: DataFrame) -> DataFrame:
    return defs.select("name").distinct()


def last_by_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each key, by an aggregation that combines map-side."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, "_last.*").select(*df.columns)


def known_instances(local: DataFrame, storage: DataFrame, clustered: bool = True) -> DataFrame:
    """Clustered: all local ids. Otherwise local ids with info together with those of the storage."""
    if clustered:
        return local.select("instance_id").distinct()
    known = local.where(F.col("info").isNotNull()).select("instance_id")
    return known.union(storage.select("instance_id")).distinct()


def instances_by_hybrid(
    local: DataFrame,
    storage: DataFrame,
    container: str | None = None,
    roles: Sequence[str] = (),
    statuses: Sequence[str] = (),
    role_match: str = "any",
    clustered: bool = True,
) -> DataFrame:
    """Ids that match locally, and in the storage too when some local info is unknown or there is no cluster.

    The choice is a scalar subquery of the plan, so with complete local info the storage filter passes nothing.
    """
    mine = instances_by(local, container, roles, statuses, role_match).select("instance_id")
    stored = storage
    if clustered:
        stored = stored.where(local.select(F.coalesce(F.bool_or(F.col("info").isNull()), F.lit(False))).scalar())
    if not roles and not statuses:
        # Only the container counts, so no record is read.
        theirs = stored.where(F.col("container_name") == container) if container else stored
    else:
        theirs = instances_by(stored, container, roles, statuses, role_match)
    return mine.union(theirs.select("instance_id")).distinct()


def reconcile_snapshot(local: DataFrame, storage: DataFrame) -> DataFrame:
    """Storage ids replace the local ones: per id KEPT, ADDED or DROPPED, and whether another refresh is needed.

    An empty local registry ignores the snapshot, so the result is empty then.
    """
    sides = local.select("instance_id", F.lit(True).alias("l"), F.lit(False).alias("s")).union(
        storage.select("instance_id", F.lit(False), F.lit(True))
    )
    per_id = sides.groupBy("instance_id").agg(F.bool_or("l").alias("l"), F.bool_or("s").alias("s"))
    change = (
        F.when(F.col("l") & F.col("s"), "KEPT").when(F.col("s"), "ADDED").otherwise("DROPPED").alias("change")
    )
    any_local = local.limit(1).select(F.count(F.lit(1)) > 0).scalar()
    any_stored = storage.limit(1).select(F.count(F.lit(1)) > 0).scalar()
    differs = per_id.select(F.coalesce(F.bool_or(F.col("l") != F.col("s")), F.lit(False))).scalar()
    return per_id.where(any_local).select("instance_id", change, (differs & any_stored).alias("needs_refresh"))


def seed_nodes(reg: DataFrame, n: int, coordinator: str | None = None, per: str | None = None) -> DataFrame:
    """Addresses of up to ``n`` instances with the smallest ids, overall or per group, without the coordinator's own."""
    found = reg.where(F.col("info.address").isNotNull())
    if coordinator is not None:
        found = exclude_container(found, coordinator)
    found = found.select("instance_id", "container_name", F.col("info.address").alias("address"))
    if per is None:
        return found.orderBy("instance_id").limit(n)
    # Catalyst cuts each group to n rows before the shuffle (window group limit).
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy("instance_id")))
    return ranked.where(F.col("rank") <= n)
