"""Queries over filters, lookups and sets of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import operators as ops
from ..plans import DEFAULT_SKEW, SkewPolicy
from . import fixtures as fx
from .register import address_text, query
from .views_sql import with_views

# Treats keys as hot from a few rows on, so that the split plans run on test tables as well.
TINY = SkewPolicy(group_rows=30, probe_bytes=0, sketch_buckets=8)


@query(
    "flt_1",
    with_views(
        "full_registry",
        """SELECT instance_id, status FROM full_registry WHERE known AND status IN ('UP', 'UNREACHABLE')
          AND (list_contains(roles, 'building') OR list_contains(roles, 'asia'))""",
    ),
)
def flt_1(spark, sf):
    found = ops.instances_by(fx.registry(spark, sf), roles=["building", "asia"], statuses=["UP", "unreachable"])
    return found.select("instance_id", F.col("info.status").alias("status"))


@query(
    "flt_1_all",
    with_views(
        "full_registry",
        """SELECT instance_id, container_name FROM full_registry WHERE known AND container_name = 'cont_7'
          AND list_contains(roles, 'building') AND list_contains(roles, 'asia')""",
    ),
)
def flt_1_all(spark, sf):
    found = ops.instances_by(fx.registry(spark, sf), "cont_7", ["building", "asia"], role_match="all")
    return found.select("instance_id", "container_name")


FLT_2_SQL = with_views(
    "full_registry f11_filters",
    """SELECT request_id, instance_id FROM f11_filters f JOIN full_registry i
      ON (f.container IS NULL OR f.container = i.container_name) AND (f.status IS NULL OR f.status = i.status)
      AND (f.roles IS NULL OR {match})
      AND (i.known OR (f.container IS NULL AND f.status IS NULL AND f.roles IS NULL))""",
)
ANY_ROLE = FLT_2_SQL.replace("{match}", "list_has_any(f.roles, i.roles)")


@query("flt_2", ANY_ROLE)
def flt_2(spark, sf, policy=DEFAULT_SKEW):
    return ops.instances_by_requests(fx.registry(spark, sf), fx.filter_requests(spark, sf), policy=policy)


@query("flt_2_split", ANY_ROLE)
def flt_2_split(spark, sf):
    return flt_2(spark, sf, TINY)


@query("flt_2_all", FLT_2_SQL.replace("{match}", "list_has_all(i.roles, f.roles)"))
def flt_2_all(spark, sf):
    return ops.instances_by_requests(fx.registry(spark, sf), fx.filter_requests(spark, sf), role_match="all")


@query(
    "flt_2_shared",
    with_views(
        "full_registry f11_filters",
        f"""WITH asked AS (SELECT *, min(request_id) OVER (PARTITION BY container, roles, status) AS asked_first FROM f11_filters)
        SELECT asked_first, instance_id, (SELECT count(*) FROM asked b WHERE b.asked_first = a.asked_first) AS requests
        FROM ({ANY_ROLE}) JOIN asked a USING (request_id) WHERE request_id = asked_first""",
    ),
)
def flt_2_shared(spark, sf):
    """Each answer once, with how many requests share it."""
    shared, answers = ops.filter_answers(fx.registry(spark, sf), fx.filter_requests(spark, sf))
    return answers.join(shared.groupBy("asked_first").agg(F.count(F.lit(1)).alias("requests")), "asked_first")


@query("flt_3", with_views("full_registry", "SELECT instance_id FROM full_registry WHERE container_name <> 'cont_0'"))
def flt_3(spark, sf):
    return ops.exclude_container(fx.registry(spark, sf), "cont_0").select("instance_id")


@query(
    "flt_4",
    with_views(
        "f5_matched full_registry",
        """SELECT event_id, kind, instance_id FROM f5_matched JOIN full_registry USING (instance_id) WHERE list_contains(roles, 'building')""",
    ),
)
def flt_4(spark, sf):
    reg = fx.registry(spark, sf)
    matched, _ = ops.match_members(fx.member_events(spark, sf), reg)
    with_roles = matched.join(reg.select("instance_id", F.col("info.roles").alias("roles")), "instance_id")
    return ops.members_with_role(with_roles, "building").select("event_id", "kind", "instance_id")


def jn_1_sql(clustered: bool) -> str:
    ask = "l.instance_id IS NOT NULL" if clustered else "true"
    return f"""SELECT r.request_id, r.instance_id, CASE WHEN l.known THEN 'FOUND' WHEN NOT ({ask}) THEN 'NOT_FOUND'
        WHEN s.broken THEN 'FAILED' WHEN s.instance_id IS NOT NULL THEN 'FOUND' ELSE 'NOT_FOUND' END AS outcome,
      CASE WHEN l.known THEN 'LOCAL' WHEN ({ask}) AND s.instance_id IS NOT NULL AND NOT s.broken THEN 'STORAGE' END AS source,
      CASE WHEN l.known THEN l.status WHEN ({ask}) AND s.instance_id IS NOT NULL AND NOT s.broken THEN s.status END AS status
    FROM f11 r LEFT JOIN local_registry l USING (instance_id) LEFT JOIN storage s USING (instance_id)"""


def _get_instances(spark, sf, clustered=True, policy=DEFAULT_SKEW):
    answers = ops.get_instances(
        fx.lookups(spark, sf), fx.local_registry(spark, sf), fx.storage(spark, sf), clustered, policy
    )
    return answers.select("request_id", "instance_id", "outcome", "source", F.col("info.status").alias("status"))


@query("jn_1", with_views("f11 local_registry storage", jn_1_sql(True)))
def jn_1(spark, sf):
    return _get_instances(spark, sf)


@query("jn_1_unclustered", with_views("f11 local_registry storage", jn_1_sql(False)))
def jn_1_unclustered(spark, sf):
    return _get_instances(spark, sf, clustered=False)


@query("jn_1_split", with_views("f11 local_registry storage", jn_1_sql(True)))
def jn_1_split(spark, sf):
    return _get_instances(spark, sf, policy=SkewPolicy(group_rows=1, probe_bytes=0))


@query(
    "jn_2",
    with_views(
        "f4 defs",
        """SELECT request_id, name, CASE WHEN defs.name IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS outcome, cpus::BIGINT AS cpus
        FROM f4 LEFT JOIN defs USING (name)""",
    ),
)
def jn_2(spark, sf):
    found = ops.get_containers(fx.identified_requests(spark, sf).select("request_id", "name"), fx.container_table(spark, sf))
    return found.select("request_id", "name", "outcome", "cpus")


def jn_7_sql(clustered: bool) -> str:
    ask = "l.instance_id IS NOT NULL" if clustered else "true"
    return f"""SELECT r.request_id, r.instance_id, CASE WHEN l.known AND l.address IS NOT NULL THEN 'TERMINATED'
        WHEN NOT ({ask}) THEN 'NOT_FOUND' WHEN s.broken THEN 'FAILED' WHEN s.instance_id IS NULL THEN 'NOT_FOUND'
        WHEN s.address IS NULL THEN 'FAILED'
        WHEN r.seq = max(r.seq) OVER (PARTITION BY r.instance_id) THEN 'TERMINATED' ELSE 'SUPERSEDED' END AS outcome
    FROM f11 r LEFT JOIN local_registry l USING (instance_id) LEFT JOIN storage s USING (instance_id)"""


def _terminations(spark, sf, clustered=True):
    return ops.resolve_terminations(
        fx.lookups(spark, sf), fx.local_registry(spark, sf), fx.storage(spark, sf), clustered
    ).drop("seq")


@query("jn_7", with_views("f11 local_registry storage", jn_7_sql(True)))
def jn_7(spark, sf):
    return _terminations(spark, sf)


@query("jn_7_unclustered", with_views("f11 local_registry storage", jn_7_sql(False)))
def jn_7_unclustered(spark, sf):
    return _terminations(spark, sf, clustered=False)


@query(
    "prj_9",
    with_views(
        "f11 local_registry storage f4 defs",
        f"""WITH outcomes AS (
          SELECT request_id::VARCHAR AS request_id, outcome FROM ({jn_1_sql(True)})
          UNION ALL SELECT request_id, CASE WHEN defs.name IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END FROM f4 LEFT JOIN defs USING (name)
          UNION ALL SELECT request_id::VARCHAR, outcome FROM ({jn_7_sql(True)})
          UNION ALL SELECT c_custkey::VARCHAR, CASE WHEN c_custkey % 2 = 0 THEN 'BAD_ID' ELSE 'UNEXPECTED' END FROM customer)
        SELECT outcome, CASE WHEN outcome IN ('FOUND', 'LIST', 'TERMINATED') THEN 200 WHEN outcome = 'SUBMITTED' THEN 202
          WHEN outcome = 'NOT_FOUND' THEN 404 WHEN outcome = 'BAD_ID' THEN 400 ELSE 500 END::BIGINT AS code, count(*) AS n
        FROM outcomes GROUP BY 1, 2""",
    ),
)
def prj_9(spark, sf):
    """how often each outcome and code occurs."""
    extra = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("request_id"),
        F.when(F.col("c_custkey") % 2 == 0, "BAD_ID").otherwise("UNEXPECTED").alias("outcome"),
    )
    parts = [df.select(F.col("request_id").cast("string").alias("request_id"), "outcome") for df in (jn_1(spark, sf), jn_2(spark, sf), jn_7(spark, sf))]
    outcomes = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(extra)
    return ops.outcome_codes(outcomes).groupBy("outcome", "code").agg(F.count(F.lit(1)).alias("n"))


JN_5_SQL = with_views(
    "f11 local_registry",
    """SELECT request_id, instance_id, CASE WHEN NOT EXISTS (SELECT 1 FROM local_registry l WHERE l.instance_id = f.instance_id)
      AND row_number() OVER (PARTITION BY instance_id ORDER BY seq) = 1 THEN 'REGISTERED' ELSE 'ALREADY_EXISTS' END AS outcome
    FROM (SELECT * FROM f11 UNION ALL SELECT request_id + 1000000, instance_id, seq + 1000000 FROM f11 WHERE seq % 5 = 0) f""",
)


def _new_records(spark, sf):
    """Lookups as new records, every fifth of them twice."""
    copies = F.when(F.col("seq") % 5 == 0, F.array(F.lit(0), F.lit(1_000_000))).otherwise(F.array(F.lit(0)))
    twice = fx.lookups(spark, sf).withColumn("copy", F.explode(copies))
    return twice.select((F.col("request_id") + F.col("copy")).alias("request_id"), "instance_id", (F.col("seq") + F.col("copy")).alias("seq"))


def _register(spark, sf, policy=DEFAULT_SKEW):
    return ops.register_if_absent(_new_records(spark, sf), fx.local_registry(spark, sf), ["seq"], policy).drop("seq")


@query("jn_5", JN_5_SQL)
def jn_5(spark, sf):
    return _register(spark, sf)


@query("jn_5_split", JN_5_SQL)
def jn_5_split(spark, sf):
    return _register(spark, sf, SkewPolicy(group_rows=2, probe_bytes=0))


@query("set_1", with_views("local_registry", "SELECT DISTINCT instance_id FROM local_registry"))
def set_1(spark, sf):
    return ops.known_instances(fx.local_registry(spark, sf), fx.storage(spark, sf))


@query(
    "set_1_unclustered",
    with_views("local_registry storage", "SELECT instance_id FROM local_registry WHERE known UNION SELECT instance_id FROM storage"),
)
def set_1_unclustered(spark, sf):
    return ops.known_instances(fx.local_registry(spark, sf), fx.storage(spark, sf), clustered=False)


HYBRID = "status IN ('UP', 'LAUNCHING') AND list_has_any(roles, ['building', 'europe'])"


@query(
    "set_2",
    with_views(
        "local_registry storage",
        f"SELECT instance_id FROM local_registry WHERE known AND {HYBRID} UNION SELECT instance_id FROM storage WHERE {HYBRID}",
    ),
)
def set_2(spark, sf):
    return ops.instances_by_hybrid(
        fx.local_registry(spark, sf), fx.storage(spark, sf), roles=["building", "europe"], statuses=["UP", "LAUNCHING"]
    )


@query("set_2_local_only", with_views("local_registry", f"SELECT instance_id FROM local_registry WHERE known AND {HYBRID}"))
def set_2_local_only(spark, sf):
    """All local info is known here, so the storage stays out."""
    local = fx.local_registry(spark, sf).where(F.col("info").isNotNull())
    return ops.instances_by_hybrid(local, fx.storage(spark, sf), roles=["building", "europe"], statuses=["UP", "LAUNCHING"])


@query(
    "set_3",
    with_views(
        "local_registry storage",
        """SELECT instance_id, CASE WHEN s.instance_id IS NULL THEN 'DROPPED' WHEN l.instance_id IS NULL THEN 'ADDED' ELSE 'KEPT' END AS change,
          true AS needs_refresh FROM local_registry l FULL JOIN storage s USING (instance_id)""",
    ),
)
def set_3(spark, sf):
    return ops.reconcile_snapshot(fx.local_registry(spark, sf), fx.storage(spark, sf))


@query("agg_2", with_views("full_registry", "SELECT DISTINCT instance_id FROM full_registry"))
def agg_2(spark, sf):
    return ops.list_instances(fx.registry(spark, sf))


@query(
    "agg_2_by_container",
    with_views(
        "full_registry defs",
        "SELECT name AS container_name, instance_id FROM defs LEFT JOIN full_registry ON container_name = name",
    ),
)
def agg_2_by_container(spark, sf):
    return ops.list_instances(fx.registry(spark, sf), by_container=True, containers=fx.container_table(spark, sf))


@query("agg_2_containers", with_views("defs", "SELECT name FROM defs"))
def agg_2_containers(spark, sf):
    return ops.list_containers(fx.container_defs(spark, sf))


@query("agg_5", with_views("defs", "SELECT name, cpus::BIGINT AS cpus, position::BIGINT AS position FROM defs"))
def agg_5(spark, sf):
    return ops.last_by_key(fx.container_defs(spark, sf), "name", ["position"]).select("name", "cpus", "position")


TOP_1 = "known AND address IS NOT NULL AND container_name <> 'cont_3'"


@query(
    "top_1",
    with_views("full_registry", f"SELECT instance_id, address FROM full_registry WHERE {TOP_1} ORDER BY instance_id LIMIT 3"),
)
def top_1(spark, sf):
    return ops.seed_nodes(fx.registry(spark, sf), 3, "cont_3").select("instance_id", address_text("address").alias("address"))


@query(
    "top_1_per_container",
    with_views(
        "full_registry",
        f"""SELECT container_name, instance_id, row_number() OVER (PARTITION BY container_name ORDER BY instance_id) AS rank
        FROM full_registry WHERE {TOP_1} QUALIFY rank <= 3""",
    ),
)
def top_1_per_container(spark, sf):
    return ops.seed_nodes(fx.registry(spark, sf), 3, "cont_3", per="container_name").select("container_name", "instance_id", "rank")
