import random

import pytest

from fleetroll import operators as ops
from fleetroll.plans import DEFAULT_SKEW
from tests import folds
from tests.helpers import SPLIT, seconds, table


REQUEST, RESPONSE = "request_id string, ts double", "request_id string, response_id string, ts double"


def correlated(spark, asked, answers, timeout, policy=DEFAULT_SKEW):
    requests, responses = table(spark, asked, REQUEST, "ts"), table(spark, answers, RESPONSE, "ts")
    return seconds(ops.correlate_responses(requests, responses, timeout, policy)), seconds(ops.orphan_responses(requests, responses, policy))


@pytest.mark.parametrize("policy", [DEFAULT_SKEW, SPLIT])
def test_correlate(spark, policy):
    asked = [("a", 0.0), ("b", 0.0), ("c", 0.0), ("d", 0.0), ("d", 50.0), ("e", 5.0), ("f", 0.0), ("f", 0.0), (None, 1.0)]
    answers = [("a", "x", 10.0), ("a", "w", 10.0), ("a", "v", 20.0), ("b", "y", 31.0), ("d", "early", 10.0), ("d", "z", 80.0), ("q", "o", 1.0)]
    answers += [("e", "before", 4.0), ("f", "f1", 0.0), (None, "n", 2.0)]
    answers += [("a", f"more{i}", 30.0 + i) for i in range(50)]
    done, orphans = correlated(spark, asked, answers, 30, policy)
    assert done == sorted(
        [
            ("a", 0.0, "ANSWERED", "w", 10.0),
            ("b", 0.0, "TIMED_OUT", "y", 31.0),
            ("c", 0.0, "UNANSWERED", None, None),
            ("d", 0.0, "ANSWERED", "early", 10.0),
            ("d", 50.0, "ANSWERED", "z", 80.0),
            ("e", 5.0, "UNANSWERED", None, None),
            ("f", 0.0, "ANSWERED", "f1", 0.0),
            ("f", 0.0, "SUPERSEDED", None, None),
            (None, 1.0, "UNANSWERED", None, None),
        ],
        key=str,
    )
    assert ("q", "o", 1.0, "Sender with ID q was not found") in orphans
    assert (None, "n", 2.0, "Sender with ID null was not found") in orphans
    rest = [("a", "x"), ("a", "v"), ("e", "before"), ("q", "o"), (None, "n")] + [("a", f"more{i}") for i in range(50)]
    assert sorted((r[:2] for r in orphans), key=str) == sorted(rest, key=str)


def test_an_answer_belongs_to_the_request_that_is_open(spark):
    """Asked at 0 and 20, answered at 5, 25 and 26; asked at 10, answered at 3."""
    asked = [("a", 0.0), ("a", 20.0), ("b", 10.0)]
    answers = [("a", "1", 5.0), ("a", "2", 25.0), ("a", "3", 26.0), ("b", "4", 3.0)]
    done, orphans = correlated(spark, asked, answers, 30)
    assert done == [("a", 0.0, "ANSWERED", "1", 5.0), ("a", 20.0, "ANSWERED", "2", 25.0), ("b", 10.0, "UNANSWERED", None, None)]
    assert [r[:3] for r in orphans] == [("a", "3", 26.0), ("b", "4", 3.0)]


@pytest.mark.parametrize("policy", [DEFAULT_SKEW, SPLIT])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_correlate_against_a_map_of_senders(spark, policy, seed):
    rng = random.Random(seed)
    asked = [(f"r{rng.randint(0, 30)}", float(rng.randint(0, 60))) for _ in range(200)] + [("r0", float(k)) for k in range(60)]
    answers = [(f"r{rng.randint(0, 35)}", f"a{k}", float(rng.randint(0, 80))) for k in range(400)] + [("r0", f"h{k}", k / 2) for k in range(200)]
    done, orphans = correlated(spark, asked, answers, 8, policy)
    assert (done, orphans) == folds.senders(asked, answers, 8)
    assert len(orphans) + sum(r[3] is not None for r in done) == len(answers)  # each response is in one result


@pytest.mark.parametrize("policy", [DEFAULT_SKEW, SPLIT])
def test_join_deadlines(spark, policy):
    starts = table(spark, [("a", 0.0), ("a", 100.0), ("b", 0.0), ("c", 0.0)], "key string, ts double", "ts")
    joins = [("a", 120.0), ("a", 121.0), ("b", 120.5), ("c", 0.0)] + [("a", 300.0 + i) for i in range(60)]
    got = seconds(ops.join_deadlines(starts, table(spark, joins, "key string, ts double", "ts"), 120, policy))
    assert got == [("a", 0.0, "JOINED", 120.0), ("a", 100.0, "JOINED", 120.0), ("b", 0.0, "TIMED_OUT", 120.0), ("c", 0.0, "JOINED", 0.0)]


@pytest.mark.parametrize("policy", [DEFAULT_SKEW, SPLIT])
def test_join_deadlines_with_ties(spark, policy):
    """A hot key whose starts and joins have two times each."""
    starts = [("a", 100.0 * (i % 2)) for i in range(500)]
    joins = [("a", 50.0 + 100.0 * (i % 2)) for i in range(500)]
    schema = "key string, ts double"
    got = seconds(ops.join_deadlines(table(spark, starts, schema, "ts"), table(spark, joins, schema, "ts"), 60, policy))
    assert got == sorted([("a", 0.0, "JOINED", 50.0)] * 250 + [("a", 100.0, "JOINED", 150.0)] * 250, key=str)


def test_completion_barrier(spark):
    rows = [("p", True, 1.0), ("p", True, 3.0), ("q", True, 1.0), ("q", False, None), ("r", None, None)]
    got = seconds(ops.completion_barrier(table(spark, rows, "parent string, ended boolean, ended_at double", "ended_at")))
    assert got == [("p", True, 3.0), ("q", False, None), ("r", False, None)]


def test_first_terminal_state(spark):
    rows = [
        ("a", 1, 1, "SUBMITTED", None, None), ("a", 2, 2, "ACCEPTED", None, None), ("a", 3, 3, "RUNNING", "h1", None), ("a", 4, 4, "FAILED", None, "late"),
        ("b", 1, 5, "SUBMITTED", None, None), ("b", 2, 6, "KILLED", None, "why"), ("c", 1, 7, "ACCEPTED", None, None),
    ]
    log = spark.createDataFrame(rows, "key string, ts int, id int, state string, host string, diagnostics string")
    got = {tuple(r) for r in ops.first_terminal_state(log).collect()}
    assert got == {("a", "RUNNING", "h1", None), ("b", "FAILED", None, "Unexpected state: KILLED\nwhy"), ("c", "PENDING", None, None)}


def test_layered_config(spark):
    rows = [("k", 2, 1, "default"), ("k", 0, 1, "old"), ("k", 0, 2, "user"), ("m", 1, 1, "staged"), ("m", 2, 9, "default")]
    got = {(r["key"], r["value"]) for r in ops.layered_config(spark.createDataFrame(rows, "key string, layer int, seq int, value string")).collect()}
    assert got == {("k", "user"), ("m", "staged")}
