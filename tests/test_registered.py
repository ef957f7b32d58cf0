"""The driver contract: every registered query against its SQL text."""

import pytest

import __spark_entry__ as e
from fleetroll.workload import catalog
from tests.oracle import connect, difference

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"

# Every operator of the survey.
OPERATORS = (
    "src_1 src_2 src_3 snk_1 snk_2 snk_3 prj_1 prj_2 prj_3 prj_4 prj_5 prj_6 prj_7 prj_8 prj_9 flt_1 flt_2 flt_3 flt_4 "
    "jn_1 jn_2 jn_3 jn_4 jn_5 jn_6 jn_7 jn_8 jn_9 set_1 set_2 set_3 set_4 agg_1 agg_2 agg_3 agg_4 agg_5 "
    "win_1 win_2 win_3 win_4 win_5 win_6 win_7 top_1 top_2 str_1 str_2 str_3 str_4 str_5 str_6"
).split()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_operator_is_registered_with_sql():
    assert set(OPERATORS) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    assert difference(duck, spark, SMALL, e.queries()[name], e.oracle_sql()[name]) is None


def test_entry(spark):
    assert e.entry(spark).columns == ["state", "instances"]
    assert e.entry(spark).count() > 0


def counts(spark, name, column):
    return {r[0]: r[1] for r in e.queries()[name](spark, MEDIUM).groupBy(column).count().collect()}


def test_known_state_counts(spark):
    got = {r["state"]: r["instances"] for r in e.queries()["win_1_counts"](spark, MEDIUM).collect()}
    assert got == {"DEAD": 878, "DEPLOYING": 585, "UP": 248, "ABSENT": 238, "UNREACHABLE": 59, "LAUNCHING": 9}


@pytest.mark.parametrize(
    "name, column, want",
    [
        ("jn_6", "outcome", {"ANSWERED": 6368, "TIMED_OUT": 5282, "UNANSWERED": 3350}),
        ("agg_3", "finished", {True: 1706, False: 13037}),
        ("agg_4", "outcome", {"RUNNING": 766, "FAILED": 731, "PENDING": 3}),
        ("jn_9", "outcome", {"LAUNCHED": 14743, "RELEASED": 45257}),
        ("top_2", "outcome", {"JOINED": 2007, "TIMED_OUT": 12993}),
        ("set_3", "change", {"KEPT": 500, "ADDED": 500, "DROPPED": 500}),
        ("win_5", "layer", {0: 43, 1: 82, 2: 25}),
        ("jn_2", "outcome", {"FOUND": 12632, "NOT_FOUND": 2368}),
    ],
)
def test_known_outcome_counts(spark, name, column, want):
    assert counts(spark, name, column) == want


@pytest.mark.parametrize(
    "name, condition, want",
    [
        ("jn_3", "true", 18957),
        ("flt_1", "true", 196),
        ("win_3", "terminated_at is not null", 82),
        ("win_4", "true", 137),
        ("jn_8", "true", 378),
        ("jn_8", "down_at is not null", 137),
        ("win_7", "registered_at is not null", 975),
        ("win_7", "registered_at is null", 340),
    ],
)
def test_known_row_counts(spark, name, condition, want):
    assert e.queries()[name](spark, MEDIUM).where(condition).count() == want
