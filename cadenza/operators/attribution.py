"""Attribution of feedback to the intent of a response (batch form).

Feedback ``f`` goes to the response of its request with the greatest
``responseTime <= feedbackTime``; if there is none, to the first response within
``wait`` after it; otherwise nowhere.  Every feedback row is attributed at most
once, however many responses a request has.

Rows are shuffled once, by request, and attributed in one pass over the request's
time.  A request may hold a large part of all rows, though: those of more than
``hot_rows`` rows, of which there can be only (rows / ``hot_rows``), are found first
and go another way.  Times are whole seconds, so the result depends on (request,
second) only: both sides are combined per second (on the map side, before any
shuffle), and those seconds are grouped by (request, time bucket).  A group thus has
at most two rows per second of a bucket.  What a bucket must know about the time
outside it is one row: the last response before it, the first one after.  Feedback
rows then look up their second; a hot second is an ordinary skewed join key, whose
partition is split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.fixed_values import PENDING_FEEDBACK_MINUTES
from cadenza.functions.measures import feedback_kind
from cadenza.functions.once import evaluated_once
from cadenza.functions.time import local_text_to_timestamp
from cadenza.operators.windows import feedback_metrics, response_metrics, valid_feedback

INTENT = ("intentType", "intentGroup")
_KEY = ("requestId", "_bucket")

#: rows of a request that one task sorts; requests with more are cut into time buckets
HOT_ROWS = 1_000_000


def _seconds(text: Column) -> Column:
    return F.unix_seconds(local_text_to_timestamp(text))


def answered_seconds(responses: DataFrame, tie: str) -> DataFrame:
    """First and last response of each request and second: ``requestId, _at, _first, _last``."""
    timed = evaluated_once(_valid_responses(responses), {"_at": _seconds(F.col("responseTime"))})
    one = F.struct(F.col("_at").alias("at"), F.col(tie).alias("tie"), *INTENT)
    return timed.groupBy("requestId", "_at").agg(F.min(one).alias("_first"), F.max(one).alias("_last"))


def seconds_in_reach(
    answered: DataFrame, seconds: DataFrame, wait_seconds: int, bucket_seconds: int
) -> DataFrame:
    """Intent for each ``requestId, _at`` of ``seconds`` that is answered in reach.

    ``answered`` is one row per request and second (:func:`answered_seconds`).
    """
    asked = seconds.select("requestId", "_at", F.lit(True).alias("_asked"))
    rows = answered.unionByName(asked, allowMissingColumns=True).filter("_at is not null").select(
        "requestId",
        F.floor(F.col("_at") / F.lit(bucket_seconds)).alias("_bucket"),
        "_at", "_first", "_last", "_asked",
    )

    # one row per request and bucket, with what lies outside the bucket
    edges = rows.groupBy(*_KEY).agg(F.min("_first").alias("_lo"), F.max("_last").alias("_hi"))
    timeline = Window.partitionBy("requestId").orderBy("_bucket")
    reach = edges.select(
        *_KEY,
        F.last("_hi", ignorenulls=True)
        .over(timeline.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_before"),
        F.first("_lo", ignorenulls=True)
        .over(timeline.rowsBetween(1, Window.unboundedFollowing))
        .alias("_after"),
    ).filter(F.col("_before").isNotNull() | F.col("_after").isNotNull())

    # inside a bucket: a response sorts before feedback of the same second; without
    # one before, the bucket's first response is the next (both frames, like the
    # edges, read the same columns, so the combined seconds are shuffled once)
    bucket = Window.partitionBy(*_KEY)
    past = bucket.orderBy("_at", F.col("_asked").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = rows.select(
        *_KEY, "_at", "_asked",
        F.last("_last", ignorenulls=True).over(past).alias("_prev"),
        F.min("_first").over(bucket).alias("_lo"),
    ).filter(F.col("_asked").isNotNull())

    following = F.coalesce("_lo", "_after")
    chosen = F.coalesce(
        "_prev",
        "_before",
        F.when(following["at"] <= F.col("_at") + F.lit(wait_seconds), following),
    )
    return (
        inside.join(reach, list(_KEY), "left")
        .select("requestId", "_at", chosen.alias("_chosen"))
        .filter(F.col("_chosen").isNotNull())
        .select("requestId", "_at", *[F.col("_chosen")[c].alias(c) for c in INTENT])
    )


def _valid_responses(responses: DataFrame) -> DataFrame:
    return responses.dropna(subset=["requestId", "responseTime", *INTENT])


def hot_requests(responses: DataFrame, feedback: DataFrame, hot_rows: int) -> DataFrame:
    """``requestId`` of more than ``hot_rows`` responses and feedback rows."""
    requests = responses.select("requestId").unionByName(feedback.select("requestId"))
    counted = requests.groupBy("requestId").agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col("_n") > F.lit(hot_rows)).select("requestId")


def _in_one_pass(responses: DataFrame, rows: DataFrame, wait_seconds: int, tie: str) -> DataFrame:
    """Valid feedback rows with their intents, by a window over each request."""
    own = [c for c in rows.columns if c != "requestId"]
    answered = evaluated_once(responses, {"_at": _seconds(F.col("responseTime"))}).select(
        "requestId", "_at", F.struct(F.col("_at").alias("at"), F.col(tie).alias("tie"), *INTENT).alias("_answer")
    )
    given = evaluated_once(rows, {"_at": _seconds(F.col("feedbackTime"))}).select(
        "requestId", "_at", F.struct(*own).alias("_fed")
    )
    both = answered.unionByName(given, allowMissingColumns=True).filter("_at is not null")
    # a response sorts before feedback of the same second
    timeline = Window.partitionBy("requestId").orderBy("_at", F.col("_fed").isNotNull(), "_answer")
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    seen = both.select(
        "requestId", "_at", "_fed",
        F.last("_answer", ignorenulls=True).over(timeline.rowsBetween(start, Window.currentRow)).alias("_prev"),
        F.first("_answer", ignorenulls=True).over(timeline.rowsBetween(start, end)).alias("_next"),
    ).filter("_fed is not null")
    near = F.col("_next.at") <= F.col("_at") + F.lit(wait_seconds)
    chosen = seen.select(
        "requestId", "_fed", F.coalesce("_prev", F.when(near, F.col("_next"))).alias("_chosen")
    ).filter("_chosen is not null")
    return chosen.select("requestId", "_fed.*", *[F.col("_chosen")[c].alias(c) for c in INTENT])


def _in_buckets(
    responses: DataFrame, feedback: DataFrame, wait_seconds: int, bucket_seconds: int, tie: str
) -> DataFrame:
    """The same for requests of any size, by seconds and time buckets."""
    rows = evaluated_once(feedback, {"_at": _seconds(F.col("feedbackTime"))})
    seconds = rows.select("requestId", "_at").distinct()
    answered = seconds_in_reach(answered_seconds(responses, tie), seconds, wait_seconds, bucket_seconds)
    return rows.join(answered, ["requestId", "_at"]).drop("_at")


def attribute_feedback(
    responses: DataFrame,
    feedback: DataFrame,
    wait_seconds: int = PENDING_FEEDBACK_MINUTES * 60,
    bucket_seconds: int = 3600,
    tie: str = "eventId",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Feedback rows with the ``intentType`` and ``intentGroup`` they count for.

    Feedback without a response in reach is left out.  ``tie`` orders responses
    of one second.  ``hot_rows`` bounds the rows one task sorts together, and
    ``bucket_seconds`` the seconds of requests with more; neither changes the result.
    """
    answered, rows = _valid_responses(responses), valid_feedback(feedback).drop(*INTENT)
    hot = F.broadcast(hot_requests(answered, rows, hot_rows))
    calm = _in_one_pass(
        answered.join(hot, "requestId", "left_anti"), rows.join(hot, "requestId", "left_anti"), wait_seconds, tie
    )
    cut = _in_buckets(
        answered.join(hot, "requestId", "left_semi"), rows.join(hot, "requestId", "left_semi"),
        wait_seconds, bucket_seconds, tie,
    )
    return calm.unionByName(cut)


def collapsed(feedback: DataFrame) -> DataFrame:
    """Valid feedback counted (``times``) per request, time and kind."""
    rows = valid_feedback(feedback).select(
        "requestId", "feedbackTime", feedback_kind("feedbackType").alias("feedbackType")
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))


def intent_metrics(
    responses: DataFrame,
    feedback: DataFrame,
    wait_seconds: int = PENDING_FEEDBACK_MINUTES * 60,
    bucket_seconds: int = 3600,
    tie: str = "eventId",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Metric deltas by intent: one per response, one per attributed feedback count.

    Feedback of a request is counted per time and kind only where the request is hot;
    elsewhere every row is a count of one, and the windows add them up before a shuffle.
    """
    answered, rows = _valid_responses(responses), valid_feedback(feedback).select(
        "requestId", "feedbackTime", "feedbackType"
    )
    hot = F.broadcast(hot_requests(answered, rows, hot_rows))
    calm = _in_one_pass(
        answered.join(hot, "requestId", "left_anti"),
        rows.join(hot, "requestId", "left_anti").withColumn("times", F.lit(1).cast("bigint")), wait_seconds, tie,
    )
    cut = _in_buckets(
        answered.join(hot, "requestId", "left_semi"), collapsed(rows.join(hot, "requestId", "left_semi")),
        wait_seconds, bucket_seconds, tie,
    )
    by_feedback = feedback_metrics(calm.unionByName(cut), *INTENT, times=F.col("times"))
    return response_metrics(responses, *INTENT).unionByName(by_feedback)
