"""Queries over sources, sinks and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import operators as ops
from .. import sources
from . import fixtures as fx
from .register import address_text, map_text, query
from .views_sql import uuid_of, with_views

DEF_COLUMNS = ["name", "cpus", "memory", "actors", "jvm_args", "properties", "environment"]
DEF_SQL = """SELECT name, cpus::BIGINT AS cpus, memory::BIGINT AS memory, actors, jvm_args,
  'app.mode=base,app.nation=' || s_nationkey AS properties, environment FROM defs"""


def _plain_defs(defs):
    return defs.select(
        "name", "cpus", "memory",
        F.array_join(F.transform("actors", lambda a: F.concat_ws("=", a["name"], a["fqn"])), ",").alias("actors"),
        F.array_join("jvm_args", ",").alias("jvm_args"),
        map_text("jvm_properties").alias("properties"),
        map_text("environment").alias("environment"),
    )


@query("src_1", with_views("defs", DEF_SQL))
def src_1(spark, sf):
    path = sources.scratch_path(spark, "defs")
    defs = fx.container_defs(spark, sf)
    sparse = F.when(F.size("environment") > 0, F.col("environment"))
    (
        defs.withColumn("environment", sparse)
        .withColumnsRenamed({"jvm_args": "jvm-args", "jvm_properties": "properties"})
        .write.json(path)
    )
    return _plain_defs(sources.read_container_defs(spark, path))


def _documents(spark, sf):
    k, doc = F.col("c_custkey"), sources.instance_document()
    damaged = (
        F.when(k % 23 == 0, F.substring(doc, 1, 20))
        .when(k % 29 == 0, F.replace(doc, F.lit('"status":"'), F.lit('"status":"X')))
        .when(k % 31 == 0, F.replace(doc, F.lit(',"extra":{}'), F.lit("")))
        .when(k % 37 == 0, F.regexp_replace(doc, '"instanceId":"[^"]*"', '"instanceId":"garbage"'))
        .otherwise(doc)
    )
    return fx.full_registry(spark, sf).select("c_custkey", damaged.alias("document"))


def _plain_registry(reg):
    return reg.select(
        "instance_id", "container_name",
        F.col("info.status").alias("status"),
        F.array_join("info.roles", ",").alias("roles"),
        address_text("info.address").alias("address"),
        F.array_join("info.actors", ",").alias("actors"),
        F.size("info.extra").alias("extras"),
    )


REGISTRY_SQL = """SELECT instance_id, container_name, status, array_to_string(roles, ',') AS roles, address,
  '/user/a0' AS actors, 0::BIGINT AS extras FROM full_registry WHERE """


MALFORMED = "c_custkey % 23 = 0 OR c_custkey % 29 = 0 OR (c_custkey % 31 <> 0 AND c_custkey % 37 = 0)"


@query("src_2", with_views("full_registry", REGISTRY_SQL + f"NOT ({MALFORMED})"))
def src_2(spark, sf):
    good, _ = sources.read_instance_records(_documents(spark, sf), "document")
    return _plain_registry(good)


@query(
    "src_2_malformed",
    with_views(
        "full_registry",
        f"""SELECT c_custkey, CASE WHEN c_custkey % 23 = 0 THEN 'malformed document'
          WHEN c_custkey % 29 = 0 THEN 'Unexpected instance status X' || status ELSE 'Unexpected instance ID garbage' END AS message
        FROM full_registry WHERE {MALFORMED}""",
    ),
)
def src_2_malformed(spark, sf):
    _, bad = sources.read_instance_records(_documents(spark, sf), "document")
    return bad.select("c_custkey", "message")


@query("snk_1", with_views("full_registry", REGISTRY_SQL + "known"))
def snk_1(spark, sf):
    path = sources.scratch_path(spark, "records")
    sources.write_instance_records(fx.registry(spark, sf), path)
    good, _ = sources.read_instance_records(spark.read.text(path), "value")
    return _plain_registry(good)


def _written_records(spark, sf):
    path = sources.scratch_path(spark, "records")
    sources.write_instance_records(fx.registry(spark, sf), path)
    return path


@query("snk_1_pruned", with_views("full_registry", REGISTRY_SQL + "known AND container_name IN ('cont_7', 'cont_11')"))
def snk_1_pruned(spark, sf):
    """Two containers, without reading the folders of the others."""
    good, _ = sources.read_stored_instances(spark, _written_records(spark, sf), ["cont_7", "cont_11"])
    return _plain_registry(good)


@query(
    "snk_1_lookup",
    with_views(
        "f11 full_registry",
        """SELECT request_id, f11.instance_id, CASE WHEN known THEN 'FOUND' ELSE 'NOT_FOUND' END AS outcome,
          CASE WHEN known THEN status END AS status FROM f11 LEFT JOIN full_registry USING (instance_id)""",
    ),
)
def snk_1_lookup(spark, sf):
    found = sources.lookup_stored_instances(fx.lookups(spark, sf).drop("seq"), _written_records(spark, sf))
    return found.select("request_id", "instance_id", "outcome", F.col("info.status").alias("status"))


@query(
    "snk_3",
    with_views(
        "f11 local_registry storage",
        """SELECT request_id, 'storage unavailable' AS message, 'at lookup' AS stack_trace
        FROM f11 JOIN local_registry l USING (instance_id) JOIN storage s USING (instance_id)
        WHERE NOT l.known AND s.broken""",
    ),
)
def snk_3(spark, sf):
    answers = ops.get_instances(fx.lookups(spark, sf), fx.local_registry(spark, sf), fx.storage(spark, sf))
    _, failures = sources.split_failures(answers)
    return failures.select("request_id", "message", F.array_join("stack_trace", "\n").alias("stack_trace"))


HEX = "[0-9a-fA-F]"
UUID_SQL = f"{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}"


def _parse_sql(view: str, text: str, front: str, extra: str = "") -> str:
    pattern = f"'^({front})-({UUID_SQL})$'"
    valid = f"regexp_matches({text}, {pattern})"
    return f"""SELECT c_custkey, {extra} CASE WHEN {valid} THEN regexp_extract({text}, {pattern}, 1) END AS container_name,
      CASE WHEN {valid} THEN lower(regexp_extract({text}, {pattern}, 2)) END AS instance_uuid, {valid} AS valid_id FROM {view}"""


@query("prj_1", with_views("f10", _parse_sql("f10", "text", ".*")))
def prj_1(spark, sf):
    return ops.parse_instance_ids(fx.id_texts(spark, sf), "text").drop("text")


@query("prj_1_first_dash", with_views("f10", _parse_sql("f10", "text", "[^-]*")))
def prj_1_first_dash(spark, sf):
    return ops.parse_instance_ids(fx.id_texts(spark, sf), "text", mode="first_dash").drop("text")


@query(
    "prj_2",
    f"SELECT o_orderkey AS seq, 'cont_' || (o_custkey % 120) || '-' || {uuid_of(chr(39) + 'new:' + chr(39) + ' || o_orderkey')} AS instance_id FROM orders",
)
def prj_2(spark, sf):
    return ops.mint_instance_ids(fx.deploy_requests(spark, sf), "name", ["seq"]).select("seq", "instance_id")


@query(
    "prj_3",
    with_views(
        "full_registry",
        """SELECT instance_id, CASE WHEN c_custkey % 13 <> 0 THEN status END AS parsed_status FROM full_registry""",
    ),
)
def prj_3(spark, sf):
    k, status = F.col("c_custkey"), F.col("info.status")
    text = (
        F.when(k % 13 == 0, F.concat(status, F.lit("?")))
        .when(k % 3 == 0, F.lower(status))
        .when(k % 3 == 1, F.initcap(status))
        .otherwise(status)
    )
    texts = fx.full_registry(spark, sf).select("instance_id", text.alias("text"))
    return ops.parse_statuses(texts, "text").drop("text")


@query("prj_4", with_views("f4", "SELECT seq, request_id FROM f4"))
def prj_4(spark, sf):
    return ops.ensure_request_ids(fx.deploy_requests(spark, sf), "seq").select("seq", "request_id")


@query(
    "prj_5",
    with_views(
        "f10",
        "WITH paths AS (SELECT c_custkey, text, '/cont_' || (c_custkey % 40) || '/' || text AS path FROM f10) "
        + _parse_sql("paths", "text", ".*", "path, text AS instance_id,"),
    ),
)
def prj_5(spark, sf):
    return ops.ids_from_paths(fx.id_paths(spark, sf), "raw_path").drop("raw_path")


@query(
    "prj_5_namespaces",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ns' || (c_custkey % 7) || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END
        ELSE 'ns' || (c_custkey % 7) || '/' || lower(c_mktsegment) END AS namespace FROM customer""",
)
def prj_5_namespaces(spark, sf):
    k = F.col("c_custkey")
    rows = fx.table(spark, sf, "customer").select(
        k,
        F.concat(F.lit("ns"), (k % 7).cast("string"), F.when(k % 2 == 0, "/").otherwise("")).alias("parent"),
        F.when(k % 3 == 0, "").otherwise(F.lower("c_mktsegment")).alias("child"),
    )
    return ops.child_namespaces(rows, "parent", "child").select("c_custkey", "namespace")


@query(
    "prj_6",
    with_views(
        "f4 defs",
        """SELECT request_id, CASE WHEN priority = '2-HIGH' THEN '-Xms1G,' ELSE '' END || jvm_args AS jvm_args,
          'app.mode=' || CASE WHEN priority = '1-URGENT' THEN 'urgent' ELSE 'base' END || ',app.nation=' || s_nationkey AS properties
        FROM f4 JOIN defs USING (name)""",
    ),
)
def prj_6(spark, sf):
    accepted = ops.expand_deploys(fx.identified_requests(spark, sf), fx.container_table(spark, sf)).accepted
    return accepted.select("request_id", F.array_join("jvm_args", ",").alias("jvm_args"), map_text("jvm_properties").alias("properties"))


@query(
    "prj_7",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN '-DENV_K=' || s_suppkey || ' ' ELSE '' END
      || '-Dapp.limits.cpus=' || (1 + s_suppkey % 4) || ' -Dapp.mode=base -Dapp.nation=' || s_nationkey AS rendered FROM supplier""",
)
def prj_7(spark, sf):
    k = F.col("s_suppkey")
    nested = F.struct(
        F.struct(
            F.lit("base").alias("mode"),
            F.col("s_nationkey").alias("nation"),
            F.struct((1 + k % 4).alias("cpus"), F.lit(None).cast("int").alias("memory")).alias("limits"),
        ).alias("app"),
        F.when(k % 2 == 1, k).alias("ENV_K"),
    )
    flat = ops.flatten_properties(fx.table(spark, sf, "supplier").select(k, nested.alias("settings")), "settings")
    return ops.render_properties(flat, "properties").select("s_suppkey", F.array_join("rendered", " ").alias("rendered"))


@query(
    "prj_8",
    """SELECT page_id, form, CASE form WHEN 'url' THEN raw WHEN 'abs' THEN 'file://' || raw ELSE 'file:///srv/app/' || raw END AS uri,
      regexp_extract(regexp_replace(raw, '[?#].*$', ''), '([^/]*)$', 1) AS file_name
    FROM (SELECT page_id, 'url' AS form, url AS raw FROM pages UNION ALL SELECT page_id, 'abs', '/abs/' || page_id FROM pages
      UNION ALL SELECT page_id, 'rel', 'rel/' || page_id FROM pages)""",
)
def prj_8(spark, sf):
    return ops.qualify_uris(fx.uris(spark, sf), "raw_uri", "/srv/app").drop("raw_uri")
