"""Requests of any size: in one pass, or cut into buckets of time."""

from __future__ import annotations

import random

import pytest
from test_attribution import _expected, _frames, _got

from cadenza.operators import attribution, windows


def _rows(seed=11):
    rng = random.Random(seed)

    def request():
        return rng.choice(["hot", str(rng.randrange(20)), str(rng.randrange(20))])

    responses = [(f"r{i}", request(), rng.randrange(8000), rng.choice("ABC")) for i in range(120)]
    return responses, [(f"f{i}", request(), rng.randrange(8000)) for i in range(200)]


@pytest.mark.parametrize("hot_rows", [0, 30, 10**6])
def test_where_a_request_is_cut_does_not_matter(spark, hot_rows):
    responses, feedback = _rows()
    r, f = _frames(spark, responses, feedback)
    got = attribution.attribute_feedback(r, f, wait_seconds=500, bucket_seconds=60, hot_rows=hot_rows)
    assert _got(got) == _expected(responses, feedback, 500)
    one, other = (
        sorted(map(tuple, windows.ai_intent(attribution.intent_metrics(r, f, 500, 60, hot_rows=n), "1 hour").collect()))
        for n in (hot_rows, 10**6)
    )
    assert one == other


def test_only_requests_of_many_rows_are_hot(spark):
    r, f = _frames(spark, *_rows())
    assert [x.requestId for x in attribution.hot_requests(r, f, 60).collect()] == ["hot"]


def test_an_ordinary_request_is_sorted_once(spark):
    """Feedback is not joined back to its seconds; only the list of hot requests is."""
    r, f = _frames(spark, *_rows())
    plan = attribution._in_one_pass(r, f, 500, "eventId")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
