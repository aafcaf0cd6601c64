"""Event-time attribution over micro-batches: against the batch form, hot requests, late rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import attribution
from cadenza.sources import files
from cadenza.streaming.timed_attribution import TimedAttribution, arrivals

RESPONSE = "eventId string, requestId string, responseTime string, intentType string, intentGroup string"
FEEDBACK = "eventId string, requestId string, feedbackTime string, feedbackType string"


def _at(second):
    return f"2024-01-01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


def _frames(spark, responses, feedback):
    r = [(e, q, _at(t), i, "g") for e, q, t, i in responses]
    f = [(e, q, _at(t), "LIKE") for e, q, t in feedback]
    return spark.createDataFrame(r, RESPONSE), spark.createDataFrame(f, FEEDBACK)


def _counts(rows):
    return sorted(tuple(r) for r in rows.groupBy("requestId", "feedbackTime", "intentType").agg(F.sum("times").alias("n")).collect())


@pytest.mark.parametrize("seed, bucket", [(2, 50)])
def test_equals_the_batch_form_with_a_hot_request(spark, tmp_path, seed, bucket):
    rng = random.Random(seed)

    def request():
        return rng.choice(["hot", str(rng.randrange(15)), str(rng.randrange(15))])

    responses = [(f"r{i}", request(), rng.randrange(8000), rng.choice("ABC")) for i in range(150)]
    feedback = [(f"f{i}", request(), rng.randrange(8000)) for i in range(250)]
    expected = attribution.attribute_feedback(*_frames(spark, responses, feedback), wait_seconds=500)
    expected = _counts(expected.withColumn("times", F.lit(1)))
    # rows arrive up to 300 s out of order
    arrival = {x[0]: x[2] + rng.randrange(300) for x in responses + feedback}
    job = TimedAttribution(spark, str(tmp_path), 300, 500, bucket, compact_after=2)
    for batch_id, start in enumerate(range(0, 8400, 2100)):
        def of_batch(rows):
            return [x for x in rows if start <= arrival[x[0]] < start + 2100]

        batch = arrivals(*_frames(spark, of_batch(responses), of_batch(feedback)))
        job.each(batch, batch_id)
        job.each(batch, batch_id)
    assert len(_counts(job.read())) < len(expected)
    job.each(arrivals(*_frames(spark, [("end", "end", 80_000, "Z")], [])), 9)
    assert _counts(job.read()) == expected
    state = job.state()
    assert state["late"] == 0 and state["closed"] == 80_000 + 1704067200 - 800
    assert job.waiting().count() == 0 and not files.exists(spark, job.late)


def test_late_rows_are_set_aside(spark, tmp_path):
    job = TimedAttribution(spark, str(tmp_path), 10, 60)
    job.each(arrivals(*_frames(spark, [("r", "a", 100, "A")], [("f", "a", 130), ("w", "b", 990)])), 0)
    # up to 920 s all is decided; 990 waits for a response up to 1050
    assert job.state()["closed"] == 1704067200 + 920
    job.each(arrivals(*_frames(spark, [("s", "z", 1000, "Z")], [])), 1)
    assert _counts(job.read()) == [("a", _at(130), "A", 1)]
    assert [r.feedbackTime for r in job.waiting().collect()] == [_at(990)]
    job.each(arrivals(*_frames(spark, [("t", "b", 1040, "B"), ("x", "a", 500, "X")], [("y", "a", 400), ("v", "a", 1001)])), 2)
    job.each(arrivals(*_frames(spark, [("end", "z", 5000, "Z")], [])), 3)
    # the late response of 500 s is nowhere; the carried one of 100 s answers 1001 s
    assert _counts(job.read()) == [("a", _at(130), "A", 1), ("a", _at(1001), "A", 1), ("b", _at(990), "B", 1)]
    late = spark.read.option("recursiveFileLookup", "true").parquet(job.late)
    assert sorted((r.requestId, r.reason) for r in late.collect()) == [("a", "late"), ("a", "late")]
    assert job.state()["late"] == 2


def test_nothing_and_nulls(spark, tmp_path):
    job = TimedAttribution(spark, str(tmp_path), 10)
    job.each(arrivals(*_frames(spark, [], [])), 0)
    assert job.read().count() == 0 and job.state()["closed"] is None
    rows = arrivals(
        spark.createDataFrame([("1", "a", None, "A", "g"), (None, "a", _at(5), "A", "g"), ("2", None, _at(1), "A", "g"), ("3", "a", "x", "A", "g")], RESPONSE),
        spark.createDataFrame([("1", "a", _at(6), None), ("2", "a", _at(6), "LIKE"), ("3", "a", None, "LIKE")], FEEDBACK),
    )
    job.each(rows, 1)
    job.each(arrivals(*_frames(spark, [("end", "z", 9000, "Z")], [])), 2)
    assert _counts(job.read()) == [("a", _at(6), "A", 1)]


def test_no_python_and_no_group_of_one_request(spark, tmp_path):
    """Plans group by request and time bucket, and combine before they shuffle."""
    r, f = _frames(spark, [("r", "hot", 100, "A")], [(f"f{i}", "hot", 200 + i) for i in range(50)])
    batch = arrivals(r, f)
    assert "Python" not in batch._jdf.queryExecution().executedPlan().toString()
    job = TimedAttribution(spark, str(tmp_path), 0, 60, 60)
    job.each(batch, 0)
    job.each(arrivals(*_frames(spark, [("end", "z", 9000, "Z")], [])), 1)
    assert sum(n for *_, n in _counts(job.read())) == 50
