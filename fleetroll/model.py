"""Record schemas and closed value sets shared by every operator."""

from pyspark.sql import types as T

# Instance statuses.
DEPLOYING = "DEPLOYING"
DEPLOY_FAILED = "DEPLOY_FAILED"
LAUNCHING = "LAUNCHING"
UP = "UP"
UNREACHABLE = "UNREACHABLE"
STATUSES = (DEPLOYING, DEPLOY_FAILED, LAUNCHING, UP, UNREACHABLE)

# Kinds of lifecycle events. Base events are status reports of the instance itself, member events come from the cluster.
REACHABLE = "REACHABLE"
REMOVED = "REMOVED"
BASE_KINDS = (DEPLOYING, LAUNCHING, UP, DEPLOY_FAILED)
MEMBER_KINDS = (UNREACHABLE, REACHABLE, REMOVED)

# States that only the fold over events produces.
ABSENT = "ABSENT"
DEAD = "DEAD"
REJECTED = "REJECTED"
STORED = "STORED"

# What became of a request.
ANSWERED = "ANSWERED"
TIMED_OUT = "TIMED_OUT"
UNANSWERED = "UNANSWERED"
SUPERSEDED = "SUPERSEDED"
ORPHAN = "ORPHAN"

# What became of a new record.
REGISTERED = "REGISTERED"
ALREADY_EXISTS = "ALREADY_EXISTS"

# What became of an unreachable member: downed by a poll or, while exiting, at once; over before; still waited for.
DOWNED = "DOWNED"
EXITING = "EXITING"
ENDED = "ENDED"
WAITING = "WAITING"

# Default settings, in seconds unless named otherwise.
LAUNCH_TIMEOUT = 90
HEARTBEAT_TIMEOUT = 36
HEARTBEAT_MISSED_LIMIT = 3
JOIN_TIMEOUT = 120
REQUEST_TIMEOUT = 30
AUTO_DOWN_POLL = 30
SEED_NODES = 3
SLOT_MODULUS = 32767

# Outcome to response code.
OUTCOME_CODES = {
    "FOUND": 200,
    "LIST": 200,
    "TERMINATED": 200,
    "SUBMITTED": 202,
    "NOT_FOUND": 404,
    "BAD_ID": 400,
    "FAILED": 500,
}
UNEXPECTED_CODE = 500

ADDRESS = T.StructType(
    [
        T.StructField("protocol", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("port", T.IntegerType()),
    ]
)

UNIQUE_ADDRESS = T.StructType(
    [
        T.StructField("address", ADDRESS),
        T.StructField("long_uid", T.LongType()),
    ]
)

INFO = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("address", UNIQUE_ADDRESS),
        T.StructField("actors", T.ArrayType(T.StringType())),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

# A registry row whose ``info`` is null is an instance known only by id.
REGISTRY = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("container_name", T.StringType()),
        T.StructField("info", INFO),
    ]
)

# The stored JSON document of one instance.
INSTANCE_DOCUMENT = T.StructType(
    [
        T.StructField("instanceId", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("containerName", T.StringType()),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField(
            "address",
            T.StructType(
                [
                    T.StructField("address", ADDRESS),
                    T.StructField("longUid", T.LongType()),
                ]
            ),
        ),
        T.StructField("actors", T.ArrayType(T.StringType())),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

ACTOR = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("fqn", T.StringType()),
    ]
)

CONTAINER_DEFS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("cpus", T.IntegerType()),
        T.StructField("memory", T.IntegerType()),
        T.StructField("actors", T.ArrayType(ACTOR)),
        T.StructField("jvm_args", T.ArrayType(T.StringType())),
        T.StructField("jvm_properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("environment", T.MapType(T.StringType(), T.StringType())),
    ]
)

LIFECYCLE_EVENT = T.StructType(
    [
        T.StructField("instance_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)
