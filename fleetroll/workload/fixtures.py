"""Fleet records derived from the driver's tables (views F1 to F12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import deterministic_uuid
from ..model import ADDRESS, INFO
from ..operators.columns import ensure_request_ids
from ..operators.registry import last_by_key
from ..plans import DEFAULT_SKEW, Ordered, RunningSum, SkewPolicy

STATUS_BY_KEY = ("DEPLOYING", "DEPLOY_FAILED", "LAUNCHING", "UP", "UNREACHABLE")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def container_defs(spark: SparkSession, sf: str) -> DataFrame:
    """F1 with its duplicates: (definition columns, position); the later position replaces the earlier."""
    k = F.col("s_suppkey")
    first = table(spark, sf, "supplier").select(
        k.alias("key"),
        _text("cont_", k).alias("name"),
        (1 + k % 4).cast("int").alias("cpus"),
        (1024 * (1 + k % 8)).cast("int").alias("memory"),
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), k % 3),
            lambda i: F.struct(_text("a", i).alias("name"), _text("com.x.A", i).alias("fqn")),
        ).alias("actors"),
        F.array(_text("-Xmx", 1 + k % 8, "G")).alias("jvm_args"),
        F.create_map(
            F.lit("app.mode"), F.lit("base"), F.lit("app.nation"), F.col("s_nationkey").cast("string")
        ).alias("jvm_properties"),
        F.when(k % 2 == 0, F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("ENV_K"), k.cast("string")))
        .alias("environment"),
        F.lit(0).cast("bigint").alias("position"),
    )
    # Every tenth definition comes twice; one scan yields both copies.
    copies = F.when(F.col("key") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        first.withColumn("position", F.explode(copies.cast("array<bigint>")))
        .withColumn("cpus", F.col("cpus") + F.col("position").cast("int"))
        .drop("key")
    )


def container_table(spark: SparkSession, sf: str) -> DataFrame:
    """F1 as a table with one row per name."""
    return last_by_key(container_defs(spark, sf), "name", ["position"]).drop("position")


def member_address(key: Column, uid: Column) -> Column:
    host = F.when(key % 50 != 3, _text("h", key % 200))
    plain = F.struct(
        F.lit("tcp").alias("protocol"), F.lit("fleet").alias("system"), host.alias("host"), (2550 + key % 7).cast("int").alias("port")
    ).cast(ADDRESS)
    return F.struct(plain.alias("address"), uid.cast("bigint").alias("long_uid"))


def instance_id(key: Column) -> Column:
    return _text("cont_", key % 40, "-", deterministic_uuid(_text("inst:", key)))


def full_registry(spark: SparkSession, sf: str) -> DataFrame:
    """F2 with complete info: (c_custkey, instance_id, container_name, info)."""
    places = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    k = F.col("c_custkey")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_BY_KEY]), (k % 5 + 1).cast("int"))
    info = F.struct(
        status.alias("status"),
        F.array_sort(F.array_distinct(F.array(F.lower("c_mktsegment"), F.lower("r_name")))).alias("roles"),
        F.when(k % 5 >= 3, member_address(k, k)).alias("address"),
        F.array(F.lit("/user/a0")).alias("actors"),
        F.create_map().cast("map<string,string>").alias("extra"),
    ).cast(INFO)
    return (
        table(spark, sf, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", instance_id(k).alias("instance_id"), _text("cont_", k % 40).alias("container_name"), info.alias("info"))
    )


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """info is unknown for every eleventh instance."""
    full = full_registry(spark, sf)
    return full.withColumn("info", F.when(F.col("c_custkey") % 11 != 0, F.col("info")))


def local_registry(spark: SparkSession, sf: str) -> DataFrame:
    return registry(spark, sf).where(F.col("c_custkey") % 3 != 2)


def storage(spark: SparkSession, sf: str) -> DataFrame:
    """F8 storage: complete info; looking up every seventh instance fails."""
    stored = full_registry(spark, sf).where(F.col("c_custkey") % 3 != 0)
    return stored.withColumn("error", F.when(F.col("c_custkey") % 7 == 0, F.lit("storage unavailable\nat lookup")))


def lifecycle_kind() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", "DEPLOYING")
        .when(kind == "click", "LAUNCHING")
        .when(kind == "view", "UP")
        .when(kind == "error", "UNREACHABLE")
        .when((kind == "purchase") & (F.col("value") >= 50), "REMOVED")
        .when(kind == "purchase", "DEPLOY_FAILED")
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def lifecycle_events(spark: SparkSession, sf: str, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """every signup of a user starts a new instance; events before the first signup are dropped."""
    rows = events(spark, sf).select(
        "user_id", F.unix_micros("ts").alias("us"), "event_id", lifecycle_kind().alias("kind"), "event_type"
    )
    counted = Ordered(rows, ["user_id"], ["us", "event_id"], policy).scan(
        inc=RunningSum(F.when(F.col("event_type") == "signup", 1).otherwise(0))
    )
    return counted.df.where(F.col("inc") > 0).select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("inc").cast("string")).alias("instance_id"),
        F.timestamp_micros("us").alias("ts"),
        "event_id",
        "kind",
    )


def deploy_requests(spark: SparkSession, sf: str) -> DataFrame:
    """F4, with some request ids missing."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.when(k % 13 != 0, deterministic_uuid(_text("req:", k))).alias("request_id"),
        k.alias("seq"),
        _text("cont_", F.col("o_custkey") % 120).alias("name"),
        (k % 4).cast("int").alias("quantity"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("-Xms1G"))).alias("jvm_args"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.create_map(F.lit("app.mode"), F.lit("urgent"))).alias("properties"),
    )


def identified_requests(spark: SparkSession, sf: str) -> DataFrame:
    return ensure_request_ids(deploy_requests(spark, sf), "seq")


def member_events(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, ts, event_id, kind, address); some uids belong to an unknown restart."""
    kind = F.col("event_type")
    member = (
        F.when(kind == "error", "UNREACHABLE")
        .when(kind == "view", "REACHABLE")
        .when((kind == "purchase") & (F.col("value") >= 50), "REMOVED")
    )
    k = F.col("user_id")
    uid = k + F.when(F.col("event_id") % 9 == 0, 1_000_000).otherwise(0)
    return (
        events(spark, sf)
        .withColumn("kind", member)
        .where(F.col("kind").isNotNull())
        .select(k.alias("c_custkey"), "ts", "event_id", "kind", member_address(k, uid).alias("address"))
    )


def deregistrations(spark: SparkSession, sf: str) -> DataFrame:
    """(instance_id, deregistered_at), null while still registered."""
    k = F.col("c_custkey")
    start = events(spark, sf).select(F.min("ts")).scalar()
    gone = F.when(k % 4 != 0, F.timestamp_micros(F.unix_micros(start) + (k % 30) * F.lit(86_400_000_000)))
    return table(spark, sf, "customer").select(instance_id(k).alias("instance_id"), gone.alias("deregistered_at"))


def requests_and_responses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """F6."""
    asked = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("ts")
    )
    answers = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")]).alias("response_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
    return asked, answers


def repeated_requests_and_responses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """F6 with one id for every four orders: ids come again, and answers come early, twice and after the next request."""
    asked, answers = requests_and_responses(spark, sf)
    folded = F.col("request_id") - F.col("request_id") % 4
    return asked.withColumn("request_id", folded), answers.withColumn("request_id", folded)


def children(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("parent"),
        (F.col("l_linestatus") == "F").alias("ended"),
        F.col("l_shipdate").cast("timestamp").alias("ended_at"),
    )


def state_log(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    state = F.when(status == "P", "ACCEPTED").when(status == "O", "RUNNING").when(status == "F", "FAILED")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderkey").alias("id"),
        state.alias("state"),
        _text("h", F.col("o_orderkey") % 200).alias("host"),
        F.col("o_orderpriority").alias("diagnostics"),
    )


def offers(spark: SparkSession, sf: str) -> DataFrame:
    """F7."""
    return (
        table(spark, sf, "lineitem")
        .select(
            F.col("l_orderkey").alias("slot"),
            F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("offered_us"),
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
        )
    )


def pending_slots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("slot"))


def deploy_results(instances: DataFrame) -> DataFrame:
    """the result of each expanded instance."""
    ok = (F.col("ordinal") + F.col("seq")) % 7 != 0
    return instances.select("instance_id", ok.alias("ok"), F.when(~ok, "no resources").alias("error"))


def id_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, text) with good and bad instance ids."""
    k = F.col("c_custkey")
    uuid = deterministic_uuid(_text("inst:", k))
    text = (
        F.when(k % 6 == 0, _text("cont_", k % 40, "-", uuid))
        .when(k % 6 == 1, _text("my-cont-", k % 40, "-", uuid))
        .when(k % 6 == 2, _text("cont", F.regexp_replace(uuid, "-", "")))
        .when(k % 6 == 3, _text("cont_", k % 40, "-", F.substring(uuid, 1, 35)))
        .when(k % 6 == 4, _text("cont_", k % 40, "-", F.upper(uuid)))
        .otherwise(F.lit(""))
    )
    return table(spark, sf, "customer").select("c_custkey", text.alias("text"))


def id_paths(spark: SparkSession, sf: str) -> DataFrame:
    """storage paths; every third one lacks the slash and has blanks after it."""
    k = F.col("c_custkey")
    plain = F.concat(F.lit("cont_"), (k % 40).cast("string"), F.lit("/"), F.col("text"))
    path = F.when(k % 3 == 0, F.concat(plain, F.lit("  "))).otherwise(F.concat(F.lit("/"), plain))
    return id_texts(spark, sf).select("c_custkey", path.alias("raw_path"))


def uris(spark: SparkSession, sf: str) -> DataFrame:
    """(uri_id, raw_uri)."""
    pages = table(spark, sf, "pages")
    number = F.col("page_id").cast("string")
    forms = F.array(
        F.struct(F.lit("url").alias("form"), F.col("url").alias("raw_uri")),
        F.struct(F.lit("abs").alias("form"), F.concat(F.lit("/abs/"), number).alias("raw_uri")),
        F.struct(F.lit("rel").alias("form"), F.concat(F.lit("rel/"), number).alias("raw_uri")),
    )
    return pages.select("page_id", F.inline(forms))


def lookup_ids(spark: SparkSession, sf: str) -> Column:
    """How many ids lookups draw from: a third more than there are customers, so some are unknown at every scale."""
    return table(spark, sf, "customer").select(F.expr("count(1) * 4 div 3")).scalar()


def lookups(spark: SparkSession, sf: str) -> DataFrame:
    """(request_id, instance_id, seq); ids above the table size are unknown."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("request_id"), instance_id((k * 7) % lookup_ids(spark, sf)).alias("instance_id"), k.alias("seq")
    )


def clock_starts(spark: SparkSession, sf: str) -> DataFrame:
    """(key, ts): every customer's heartbeat clock starts with the first event of all."""
    start = events(spark, sf).select(F.min("ts")).scalar()
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), start.alias("ts"))


def filter_requests(spark: SparkSession, sf: str) -> DataFrame:
    """one filter request per nation, with a role, a container or neither."""
    n = F.col("n_nationkey")
    text = F.element_at(F.array(*[F.lit(s) for s in ("up", "UP", "launching", "invalid", "")]), (n % 5 + 1).cast("int"))
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    roles = F.when(n % 3 == 0, F.array(F.lower("r_name"), F.lit("building")))
    return places.select(
        n.alias("request_id"),
        F.when(n % 3 == 1, _text("cont_", n)).alias("container"),
        roles.alias("roles"),
        F.array(text).alias("statuses"),
    )


def config_layers(spark: SparkSession, sf: str) -> DataFrame:
    """F12."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat_ws(".", "p_brand", "p_type").alias("key"),
        F.when(k % 40 == 0, 0).when(k % 10 == 1, 1).otherwise(2).alias("layer"),
        k.alias("seq"),
        F.col("p_name").alias("value"),
    )
