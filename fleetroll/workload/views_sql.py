"""The fixture views as SQL common table expressions."""

from __future__ import annotations

UUID_SHAPE = "'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5'"


def uuid_of(seed: str) -> str:
    return f"regexp_replace(md5({seed}), {UUID_SHAPE})"


def instance_id(key: str) -> str:
    seed = f"'inst:' || ({key})"
    return f"('cont_' || (({key}) % 40) || '-' || {uuid_of(seed)})"


def address_text(key: str, uid: str) -> str:
    host = f"CASE WHEN ({key}) % 50 <> 3 THEN 'h' || (({key}) % 200) ELSE '-' END"
    return f"('tcp://fleet@' || {host} || ':' || (2550 + ({key}) % 7) || '#' || ({uid}))"


#: Lookups draw from a third more ids than there are customers, so some are unknown at every scale.
LOOKUP_IDS = "(SELECT (count(*) * 4) // 3 FROM customer)"

KIND = """CASE event_type WHEN 'signup' THEN 'DEPLOYING' WHEN 'click' THEN 'LAUNCHING' WHEN 'view' THEN 'UP'
  WHEN 'error' THEN 'UNREACHABLE' WHEN 'purchase' THEN CASE WHEN value >= 50 THEN 'REMOVED' ELSE 'DEPLOY_FAILED' END END"""

VIEWS: dict[str, tuple[list[str], str]] = {
    "defs_all": (
        [],
        """SELECT 'cont_' || s_suppkey AS name, 1 + s_suppkey % 4 + p AS cpus, 1024 * (1 + s_suppkey % 8) AS memory,
          array_to_string(list_transform(range(0, s_suppkey % 3 + 1), lambda i: 'a' || i || '=com.x.A' || i), ',') AS actors,
          '-Xmx' || (1 + s_suppkey % 8) || 'G' AS jvm_args, s_nationkey,
          CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'ENV_K=' || s_suppkey END AS environment, p AS position
        FROM supplier, (VALUES (0), (1)) c(p) WHERE p = 0 OR s_suppkey % 10 = 0""",
    ),
    "defs": (["defs_all"], "SELECT * FROM defs_all QUALIFY row_number() OVER (PARTITION BY name ORDER BY position DESC) = 1"),
    "full_registry": (
        [],
        f"""SELECT c_custkey, {instance_id('c_custkey')} AS instance_id, 'cont_' || (c_custkey % 40) AS container_name,
          ['DEPLOYING', 'DEPLOY_FAILED', 'LAUNCHING', 'UP', 'UNREACHABLE'][c_custkey % 5 + 1] AS status,
          list_sort(list_distinct([lower(c_mktsegment), lower(r_name)])) AS roles,
          CASE WHEN c_custkey % 5 >= 3 THEN {address_text('c_custkey', 'c_custkey')} END AS address,
          c_custkey % 11 <> 0 AS known
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "local_registry": (["full_registry"], "SELECT * FROM full_registry WHERE c_custkey % 3 <> 2"),
    "storage": (["full_registry"], "SELECT *, c_custkey % 7 = 0 AS broken FROM full_registry WHERE c_custkey % 3 <> 0"),
    "f3": (
        [],
        f"""SELECT user_id || ':' || inc AS instance_id, us, event_id, kind FROM (
          SELECT user_id, epoch_us(ts) AS us, event_id, {KIND} AS kind,
            sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS inc
          FROM events) WHERE inc > 0""",
    ),
    "f4": (
        [],
        f"""SELECT coalesce(CASE WHEN o_orderkey % 13 <> 0 THEN {uuid_of("'req:' || o_orderkey")} END,
            {uuid_of("'fill:' || o_orderkey")}) AS request_id,
          o_orderkey AS seq, 'cont_' || (o_custkey % 120) AS name, (o_orderkey % 4)::INTEGER AS quantity, o_orderpriority AS priority
        FROM orders""",
    ),
    "f5": (
        [],
        f"""SELECT user_id AS c_custkey, epoch_us(ts) AS us, event_id, kind,
          {address_text('user_id', 'user_id + CASE WHEN event_id % 9 = 0 THEN 1000000 ELSE 0 END')} AS address
        FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'UNREACHABLE' WHEN event_type = 'view' THEN 'REACHABLE'
                WHEN event_type = 'purchase' AND value >= 50 THEN 'REMOVED' END AS kind FROM events)
        WHERE kind IS NOT NULL""",
    ),
    "by_address": (
        ["full_registry"],
        "SELECT address, min(instance_id) AS instance_id FROM full_registry WHERE known AND address IS NOT NULL GROUP BY address",
    ),
    "f5_matched": (["f5", "by_address"], "SELECT f5.*, instance_id FROM f5 JOIN by_address USING (address)"),
    "f6_requests": ([], "SELECT o_orderkey AS request_id, epoch_us(o_orderdate) AS us FROM orders"),
    "f6_responses": (
        [],
        "SELECT l_orderkey AS request_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS response_id, epoch_us(l_shipdate) AS us FROM lineitem",
    ),
    "f6_repeated": (["f6_requests"], "SELECT request_id - request_id % 4 AS request_id, us FROM f6_requests"),
    "f6_owned": (
        ["f6_repeated", "f6_responses"],
        """SELECT p.*, q.us AS asked_us, row_number() OVER (PARTITION BY p.request_id, q.us ORDER BY p.us, p.response_id) AS nth
        FROM (SELECT request_id - request_id % 4 AS request_id, response_id, us FROM f6_responses) p
        ASOF LEFT JOIN (SELECT DISTINCT * FROM f6_repeated) q ON p.request_id = q.request_id AND p.us >= q.us""",
    ),
    "expanded": (
        ["f4", "defs"],
        f"""SELECT f4.request_id, seq, f4.name AS container_name, ordinal, priority, cpus, memory, actors, jvm_args, s_nationkey,
          f4.name || '-' || {uuid_of("'new:' || request_id || ':' || ordinal")} AS instance_id, environment
        FROM f4 JOIN defs USING (name), LATERAL (SELECT unnest(generate_series(1, f4.quantity)) AS ordinal) o""",
    ),
    "f10": (
        [],
        f"""SELECT c_custkey, CASE c_custkey % 6
            WHEN 0 THEN 'cont_' || (c_custkey % 40) || '-' || u
            WHEN 1 THEN 'my-cont-' || (c_custkey % 40) || '-' || u
            WHEN 2 THEN 'cont' || replace(u, '-', '')
            WHEN 3 THEN 'cont_' || (c_custkey % 40) || '-' || substr(u, 1, 35)
            WHEN 4 THEN 'cont_' || (c_custkey % 40) || '-' || upper(u)
            ELSE '' END AS text
        FROM (SELECT c_custkey, {uuid_of("'inst:' || c_custkey")} AS u FROM customer)""",
    ),
    "f11": (
        [],
        f"SELECT c_custkey AS request_id, {instance_id('(c_custkey * 7) % ' + LOOKUP_IDS)} AS instance_id, c_custkey AS seq FROM customer",
    ),
    "f11_filters": (
        [],
        """SELECT n_nationkey::BIGINT AS request_id, CASE WHEN n_nationkey % 3 = 1 THEN 'cont_' || n_nationkey END AS container,
          CASE WHEN n_nationkey % 3 = 0 THEN [lower(r_name), 'building'] END AS roles,
          ['UP', 'UP', 'LAUNCHING', NULL, NULL][n_nationkey % 5 + 1] AS status
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "f12": (
        [],
        """SELECT p_brand || '.' || p_type AS key,
          CASE WHEN p_partkey % 40 = 0 THEN 0 WHEN p_partkey % 10 = 1 THEN 1 ELSE 2 END AS layer, p_partkey AS seq, p_name AS value
        FROM part""",
    ),
}


def with_views(names: str, body: str) -> str:
    """``body`` behind the WITH clause of the named views and all they need."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        add(name)
    clauses = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in needed)
    own = body.lstrip()
    if own.upper().startswith("WITH "):
        return f"WITH {clauses},\n{own[5:]}"
    return f"WITH {clauses}\n{own}"
