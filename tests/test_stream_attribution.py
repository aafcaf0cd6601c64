from __future__ import annotations

import pandas as pd
import streams
from pyspark.sql import functions as F

from cadenza.catalog import DAY
from cadenza.operators import attribution
from cadenza.plans import stand_ins as S
from cadenza.streaming.attribution import _combined, attribute_stream

ROW = (
    "kind string, eventId string, requestId string, userId long, at string, "
    "intentType string, intentGroup string, feedbackType string"
)


def _responses(df):
    return df.filter("kind = 'R'").select(
        "eventId", "requestId", F.col("at").alias("responseTime"), "intentType", "intentGroup"
    )


def _feedback(df):
    return df.filter("kind = 'F'").select(
        "eventId", "requestId", "userId", F.col("at").alias("feedbackTime"), "feedbackType"
    )


def _r(request, at, intent, event="r"):
    return ("R", event, request, None, f"2024-01-01 {at}", intent, "g", None)


def _f(request, at, event="f", kind="LIKE"):
    return ("F", event, request, 1, f"2024-01-01 {at}", None, None, kind)


def _run(spark, tmp_path, batches, **options):
    frames = [spark.createDataFrame(b, ROW) for b in batches]
    source = str(tmp_path / "in")
    streams.write_in_order(spark, frames, source)
    out = streams.run(
        spark, source, frames[0].schema,
        lambda s: attribute_stream(_responses(s), _feedback(s), **options), str(tmp_path),
        no_data_batches=False,
    )
    return sorted(
        (r.requestId, r.feedbackTime[11:], r.feedbackType, r.intentType, r.times)
        for r in out.collect()
    )


def test_order_of_arrival_and_duplicate_responses(spark, tmp_path):
    rows = _run(
        spark, tmp_path,
        [
            [_r("a", "10:00:00", "x"), _f("b", "09:59:00"), _f("b", "09:59:00", "f2")],
            [_f("a", "10:01:00"), _r("b", "10:00:00", "y"), _f("nobody", "10:00:00")],
            [_r("a", "10:02:00", "z"), _f("a", "10:03:00")],
            # arrives last: counts for the last intent whatever its own time
            [_f("a", "09:00:00", kind="CLICK")],
        ],
    )
    assert rows == [
        ("a", "09:00:00", "CLICK", "z", 1),
        ("a", "10:01:00", "LIKE", "x", 1),
        ("a", "10:03:00", "LIKE", "z", 1),
        ("b", "09:59:00", "LIKE", "y", 2),
    ]


def test_waiting_feedback_is_dropped_by_the_timer(spark, tmp_path):
    rows = _run(
        spark, tmp_path,
        [[_f("a", "09:59:00")], [_f("other", "09:00:00")], [_r("a", "10:00:00", "x")]],
        wait_ms=0,
    )
    assert rows == []


def test_event_time_limit(spark, tmp_path):
    rows = _run(
        spark, tmp_path,
        [
            [_f("a", "08:00:00"), _f("b", "09:30:00")],
            [_r("a", "10:00:00", "x"), _r("b", "10:00:00", "x")],
        ],
        event_wait_seconds=3600,
    )
    assert rows == [("b", "09:30:00", "LIKE", "x", 1)]


def test_a_hot_request_is_combined_before_the_shuffle():
    n = 3000
    frame = pd.DataFrame({
        "requestId": ["hot"] * n, "kind": [i % 2 for i in range(n)], "feedbackTime": ["t"] * n,
        "tie": [f"{i:05d}" for i in range(n)], "intentType": ["I"] * n, "intentGroup": ["G"] * n,
        "feedbackType": ["LIKE"] * n, "times": [i % 2 for i in range(n)], "at": [7] * n,
    })
    (out,) = list(_combined(iter([frame])))
    assert list(out[out["kind"] == 0]["tie"]) == ["00000", "02998"]
    assert list(out[out["kind"] == 1]["times"]) == [n // 2]


def test_one_batch_agrees_with_the_batch_form(spark, tmp_path, sf_dir):
    orders, lineitem = (S.table(spark, sf_dir, n) for n in ("orders", "lineitem"))
    responses = S.responses(orders, "o_custkey")
    feedback = S.feedback_of_customers(lineitem, orders)
    expected = (
        attribution.attribute_feedback(responses, feedback, 60 * DAY, 90 * DAY)
        .groupBy("requestId", "feedbackTime", "feedbackType", "intentType", "intentGroup")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    both = responses.withColumn("kind", F.lit("R")).unionByName(
        feedback.withColumn("kind", F.lit("F")), allowMissingColumns=True
    )
    source = str(tmp_path / "in")
    both.coalesce(1).write.parquet(source)
    out = streams.run(
        spark, source, both.schema,
        lambda s: attribute_stream(
            s.filter("kind = 'R'"), s.filter("kind = 'F'"),
            event_wait_seconds=60 * DAY,
        ),
        str(tmp_path),
        no_data_batches=False,
    )
    actual = out.groupBy(*expected.columns[:-1]).agg(F.sum("times").alias("n"))
    assert actual.exceptAll(expected).count() == 0
    assert expected.exceptAll(actual).count() == 0
    assert expected.count() > 1000
