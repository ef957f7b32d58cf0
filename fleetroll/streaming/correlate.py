"""Requests and responses as streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import MICROS, to_timestamp
from ..model import ANSWERED, ORPHAN, REQUEST_TIMEOUT, SUPERSEDED, TIMED_OUT, UNANSWERED
from ..operators.correlate import sender_not_found
from .fold import BUCKETS, SLOT, Fold, folded, ship_by_value, timed


class OpenRequest(Fold):
    """State: since when a request of the id is open."""

    state_schema = "asked bigint"
    start = (None,)
    columns = ["us", "is_answer", "response_id"]
    output_schema = "asked_us bigint, outcome string, response_id string, answered_us bigint"

    def __init__(self, timeout_us: int, give_up_us: int, given_up: str):
        self.timeout_us, self.give_up_us, self.given_up = timeout_us, give_up_us, given_up

    def deadline(self, state):
        return None if state[0] is None else state[0] + self.give_up_us

    def expire(self, state):
        return self.start, [[state[0]], [self.given_up], [None], [None]]

    def fold_keys(self, states, sizes, us, is_answer, response_id):
        """All keys at once: rows in order by key, an open request first; what follows a row of its key decides."""
        key = np.repeat(np.arange(len(sizes)), sizes)
        held = [k for k, state in enumerate(states) if state[0] is not None]
        at = (np.cumsum(sizes) - sizes)[held]
        us = np.insert(us, at, [states[k][0] for k in held])
        is_answer = np.insert(is_answer, at, False)
        response_id = np.insert(response_id.astype(object), at, None)
        key = np.insert(key, at, held)

        followed = np.append(key[1:] == key[:-1], False)
        asked = np.flatnonzero(~is_answer & followed)
        following = us[asked + 1]
        kept = following <= us[asked] + self.give_up_us
        answered = is_answer[asked + 1] & kept
        outcome = np.where(following <= us[asked] + self.timeout_us, ANSWERED, TIMED_OUT)
        outcome = np.where(is_answer[asked + 1], outcome, SUPERSEDED)
        outcome = np.where(kept, outcome, self.given_up)
        taken = np.zeros(len(us), bool)
        taken[asked[answered] + 1] = True
        orphans = np.flatnonzero(is_answer & ~taken)
        out = [
            us[asked].tolist() + [None] * len(orphans),
            outcome.tolist() + [ORPHAN] * len(orphans),
            np.where(answered, response_id[asked + 1], None).tolist() + response_id[orphans].tolist(),
            np.where(answered, following.astype(object), None).tolist() + us[orphans].tolist(),
        ]
        after = [self.start] * len(states)
        for k in np.flatnonzero(~is_answer & ~followed).tolist():
            after[key[k]] = (int(us[k]),)
        return after, np.append(key[asked], key[orphans]), out


ship_by_value(__name__)


def stream_correlate(
    requests: DataFrame,
    responses: DataFrame,
    timeout: float = REQUEST_TIMEOUT,
    give_up: float | None = None,
    slot: float = SLOT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """What became of every request and every response (request_id, asked_at, outcome, response_id, answered_at, message).

    Inputs are (request_id, ts) and (request_id, response_id, ts), each with a watermark on ``ts``. As in
    ``correlate_responses``, a request is open to its first answer or the next request of its id: ANSWERED, TIMED_OUT by
    a late answer, or SUPERSEDED. One that stays open is dropped ``give_up`` seconds after it was asked, as UNANSWERED. By
    default that is the deadline itself, where it is TIMED_OUT without an answer. Answers that no open request takes are
    rows of their own, ORPHAN with a message.
    """
    slot_us, timeout_us = int(slot * MICROS), int(timeout * MICROS)
    asked = requests.select("request_id", "ts", F.lit(False).alias("is_answer"), F.lit(None).cast("string").alias("response_id"))
    answers = responses.select("request_id", "ts", F.lit(True).alias("is_answer"), F.col("response_id").cast("string").alias("response_id"))
    log = asked.unionByName(answers).where(F.col("request_id").isNotNull())
    give_up_us, given_up = (timeout_us, TIMED_OUT) if give_up is None else (int(give_up * MICROS), UNANSWERED)
    rule = OpenRequest(timeout_us, give_up_us, given_up)
    rows = folded(timed(log, "ts"), "request_id", rule, slot_us, ["is_answer", "response_id"], buckets=buckets)
    return rows.select(
        "request_id",
        to_timestamp(F.col("asked_us")).alias("asked_at"),
        "outcome",
        "response_id",
        to_timestamp(F.col("answered_us")).alias("answered_at"),
        F.when(F.col("outcome") == ORPHAN, sender_not_found(F.col("request_id"))).alias("message"),
    )
