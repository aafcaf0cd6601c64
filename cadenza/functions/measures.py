"""Metric deltas and guarded means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import trim_all

#: feedback kinds and the delta column each one feeds
FEEDBACK_COLUMNS = {
    "LIKE": "likeCount",
    "DISLIKE": "dislikeCount",
    "FOLLOWUP": "followupCount",
    "CLICK": "clickCount",
}

#: the additive measures of a metric delta
DELTA_COLUMNS = (
    "requestCount",
    "successCount",
    "latencySum",
    "latencyCount",
    *FEEDBACK_COLUMNS.values(),
)


def zero() -> Column:
    return F.lit(0).cast("bigint")


def one_if(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def response_deltas() -> list[Column]:
    """Deltas of one response; the frame has ``success`` and ``latencyMs``."""
    latency = F.col("latencyMs")
    return [
        F.lit(1).cast("bigint").alias("requestCount"),
        one_if(F.coalesce(F.col("success"), F.lit(False))).alias("successCount"),
        F.coalesce(latency, zero()).alias("latencySum"),
        one_if(latency.isNotNull()).alias("latencyCount"),
        *[zero().alias(name) for name in FEEDBACK_COLUMNS.values()],
    ]


def feedback_kind(c: Column | str) -> Column:
    return F.upper(trim_all(c))


def feedback_deltas(kind: Column, times: Column | None = None) -> list[Column]:
    """Deltas of a feedback row of a normalized kind.

    An unknown kind gives zeros only, which still open a window.  ``times``
    counts rows already collapsed into one.
    """
    count = F.lit(1).cast("bigint") if times is None else times
    return [
        *[zero().alias(name) for name in DELTA_COLUMNS[:4]],
        *[
            F.when(kind == word, count).otherwise(zero()).alias(name)
            for word, name in FEEDBACK_COLUMNS.items()
        ],
    ]


def guarded_mean(total: Column, count: Column) -> Column:
    """Integer mean that truncates towards zero and is 0 for an empty count."""
    # the guard sits inside the divisor too: ANSI mode evaluates no 0 division
    return F.when(count == 0, zero()).otherwise(
        F.call_function("div", total, F.when(count == 0, F.lit(1)).otherwise(count))
    )
