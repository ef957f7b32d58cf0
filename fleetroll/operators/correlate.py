"""Requests and their answers, children and their ends, logs and their first final state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import MICROS, micros, to_timestamp
from ..model import ANSWERED, JOIN_TIMEOUT, REQUEST_TIMEOUT, SUPERSEDED, TIMED_OUT, UNANSWERED
from ..plans import DEFAULT_SKEW, Before, Next, Ordered, SkewPolicy


def answer_log(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Both tables as one log (request_id, us, is_answer, response_id); a request comes before an answer of the same time."""
    asked = requests.select(
        "request_id", micros("ts").alias("us"), F.lit(False).alias("is_answer"), F.lit(None).cast("string").alias("response_id")
    )
    answers = responses.select(
        "request_id", micros("ts").alias("us"), F.lit(True).alias("is_answer"), F.col("response_id").cast("string").alias("response_id")
    )
    return asked.unionByName(answers)


def request_outcome(is_answer: Column, answered_us: Column, asked_us: Column, timeout: float) -> Column:
    """What became of a request, from what follows it for its id: nothing, another request, or an answer."""
    return (
        F.when(is_answer.isNull(), UNANSWERED)
        .when(~is_answer, SUPERSEDED)
        .when(answered_us <= asked_us + int(timeout * MICROS), ANSWERED)
        .otherwise(TIMED_OUT)
    )


def sender_not_found(request_id: Column) -> Column:
    return F.concat(F.lit("Sender with ID "), F.coalesce(request_id.cast("string"), F.lit("null")), F.lit(" was not found"))


def correlate_responses(
    requests: DataFrame, responses: DataFrame, timeout: float = REQUEST_TIMEOUT, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Per request (request_id, asked_at): ANSWERED, TIMED_OUT (by a late answer), UNANSWERED or SUPERSEDED, and its answer.

    Inputs are (request_id, ts) and (request_id, response_id, ts). A request is open from its time to its first answer or
    the next request of its id, whichever comes first, and only an open request takes an answer: ``orphan_responses`` are
    the others. So what follows a request directly in the log of its id decides, and one shuffle and sort does it all.
    A request without an id takes no answer.
    """
    following = F.struct("us", "is_answer", "response_id")
    log = Ordered(answer_log(requests, responses), ["request_id"], ["us", "is_answer", "response_id"], policy)
    asked = log.scan(_next=Next(following)).where(~F.col("is_answer")).df
    answered = F.coalesce(F.col("_next.is_answer"), F.lit(False)) & F.col("request_id").isNotNull()
    named = F.when(F.col("request_id").isNotNull(), F.col("_next.is_answer"))
    return asked.select(
        "request_id",
        to_timestamp(F.col("us")).alias("asked_at"),
        request_outcome(named, F.col("_next.us"), F.col("us"), timeout).alias("outcome"),
        F.when(answered, F.col("_next.response_id")).alias("response_id"),
        to_timestamp(F.when(answered, F.col("_next.us"))).alias("answered_at"),
    )


def orphan_responses(requests: DataFrame, responses: DataFrame, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """Failure rows (request_id, response_id, ts, message) for the answers that no open request takes.

    These are answers to ids that were never asked, answers before their request, and all after the first one. Together
    with the answers in ``correlate_responses`` every response is in exactly one of the two.
    """
    log = Ordered(answer_log(requests, responses), ["request_id"], ["us", "is_answer", "response_id"], policy)
    taken = F.col("request_id").isNotNull() & ~F.coalesce("_after_answer", F.lit(True))
    orphans = log.scan(_after_answer=Before(F.col("is_answer"))).where(F.col("is_answer")).where(~taken).df
    return orphans.select(
        "request_id", "response_id", to_timestamp(F.col("us")).alias("ts"), sender_not_found(F.col("request_id")).alias("message")
    )


def join_deadlines(
    starts: DataFrame, joins: DataFrame, timeout: float = JOIN_TIMEOUT, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """Per start (key, ts): JOINED at the first join (key, ts) within the timeout, else TIMED_OUT at its end.

    Runs backwards through starts and joins of a key, carrying the nearest later join: an as-of join in one shuffle.
    """
    log = (
        starts.select("key", micros("ts").alias("us"), F.lit(1).alias("is_start"))
        # Joins at one time are alike; without repeats the order has few ties, however many joins a key has.
        .union(joins.select("key", micros("ts"), F.lit(0)).distinct())
        .withColumn("_back", -F.col("us"))
    )
    next_join = Ordered(log, ["key"], ["_back", "is_start"], policy).scan(
        join_us=Before(F.when(F.col("is_start") == 0, F.col("us")))
    )
    deadline = F.col("us") + int(timeout * MICROS)
    joined = F.coalesce(F.col("join_us") <= deadline, F.lit(False))
    return next_join.df.where(F.col("is_start") == 1).select(
        "key",
        to_timestamp(F.col("us")).alias("started_at"),
        F.when(joined, "JOINED").otherwise(TIMED_OUT).alias("outcome"),
        to_timestamp(F.when(joined, F.col("join_us")).otherwise(deadline)).alias("decided_at"),
    )


def completion_barrier(children: DataFrame) -> DataFrame:
    """Per parent of (parent, ended, ended_at): finished once all children ended, at the last end."""
    per_parent = children.groupBy("parent").agg(
        F.bool_and(F.coalesce("ended", F.lit(False))).alias("finished"), F.max("ended_at").alias("last_end")
    )
    return per_parent.select("parent", "finished", F.when(F.col("finished"), F.col("last_end")).alias("finished_at"))


def first_terminal_state(log: DataFrame) -> DataFrame:
    """Per key of (key, ts, id, state, host, diagnostics): RUNNING, FAILED or still PENDING.

    The first state other than SUBMITTED and ACCEPTED decides; RUNNING succeeds with its host, any other fails.
    """
    waiting = F.col("state").isin("SUBMITTED", "ACCEPTED")
    first = F.min_by(F.struct("state", "host", "diagnostics"), F.when(~waiting, F.struct("ts", "id")))
    decided = log.groupBy("key").agg(first.alias("f"))
    state = F.col("f.state")
    outcome = F.when(state.isNull(), "PENDING").when(state == "RUNNING", "RUNNING").otherwise("FAILED")
    failed = F.concat(F.lit("Unexpected state: "), state, F.lit("\n"), F.coalesce("f.diagnostics", F.lit("")))
    return decided.select(
        "key",
        outcome.alias("outcome"),
        F.when(state == "RUNNING", F.col("f.host")).alias("host"),
        F.when(outcome == "FAILED", failed).alias("message"),
    )
