from __future__ import annotations

import random

import pytest

from cadenza.operators import attribution, windows

RESPONSE = ("eventId string, requestId string, responseTime string, intentType string, "
            "intentGroup string, success boolean, latencyMs long")
FEEDBACK = "eventId string, requestId string, feedbackTime string, feedbackType string"


def _at(second: int) -> str:
    return f"2024-01-01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


def _frames(spark, responses, feedback):
    r = [(e, q, _at(t), i, "g", True, 1) for e, q, t, i in responses]
    f = [(e, q, _at(t), "LIKE") for e, q, t in feedback]
    return spark.createDataFrame(r, RESPONSE), spark.createDataFrame(f, FEEDBACK)


def _expected(responses, feedback, wait):
    out = []
    for e, q, t in feedback:
        own = sorted((rt, re, i) for re, rq, rt, i in responses if rq == q)
        before = [x for x in own if x[0] <= t]
        after = [x for x in own if t < x[0] <= t + wait]
        pick = before[-1] if before else after[0] if after else None
        if pick:
            out.append((e, pick[2]))
    return sorted(out)


def _got(df):
    return sorted((r.eventId, r.intentType) for r in df.collect())


def test_cases(spark):
    h = 3600
    responses = [("1", "a", 10 * h, "A"), ("2", "b", 10 * h, "B"), ("3", "c", 10 * h, "C"),
                 ("4", "d", 10 * h, "x"), ("5", "d", 10 * h + 30, "y")]
    feedback = [("fa", "a", 10 * h + 60), ("fb", "b", 10 * h - 60), ("fc", "c", 8 * h),
                ("fd", "d", 10 * h + 60), ("fe", "nobody", 10 * h), ("same", "a", 10 * h)]
    r, f = _frames(spark, responses, feedback)
    assert _got(attribution.attribute_feedback(r, f)) == [
        ("fa", "A"), ("fb", "B"), ("fd", "y"), ("same", "A"),
    ]


@pytest.mark.parametrize("bucket", [1, 60, 3600, 10**6])
def test_bucket_length_does_not_matter(spark, bucket):
    rng = random.Random(7)
    # request "hot" holds a third of all rows
    def request():
        return rng.choice(["hot", str(rng.randrange(20)), str(rng.randrange(20))])

    responses = [(f"r{i}", request(), rng.randrange(8000), rng.choice("ABC")) for i in range(120)]
    feedback = [(f"f{i}", request(), rng.randrange(8000)) for i in range(200)]
    r, f = _frames(spark, responses, feedback)
    for wait in (0, 500, 3600):
        got = attribution.attribute_feedback(r, f, wait_seconds=wait, bucket_seconds=bucket)
        assert _got(got) == _expected(responses, feedback, wait)


def test_each_feedback_counts_once(spark):
    responses = [(str(i), "q", 100 + i, "A") for i in range(5)]
    r, f = _frames(spark, responses, [("f", "q", 500)])
    stats = windows.ai_intent(attribution.intent_metrics(r, f), "1 hour").collect()
    assert [(s.requestCount, s.likeCount, s.avgLatencyMs) for s in stats] == [(5, 1, 1)]


def test_one_hot_second_is_combined_before_the_shuffle(spark):
    responses = [("r", "hot", 100, "A")]
    feedback = [(f"f{i}", "hot", 200) for i in range(300)]
    r, f = _frames(spark, responses, feedback)
    counted = attribution.collapsed(f).collect()
    assert [(c.requestId, c.feedbackType, c.times) for c in counted] == [("hot", "LIKE", 300)]
    assert len(_got(attribution.attribute_feedback(r, f))) == 300
    stats = windows.ai_intent(attribution.intent_metrics(r, f), "1 hour").collect()
    assert [(s.requestCount, s.likeCount) for s in stats] == [(1, 300)]
