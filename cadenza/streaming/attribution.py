"""Attribution of feedback to responses on streams.

Across micro-batches the order of arrival decides: feedback counts for the last
intent known for its request, and waits for the next response if there is none.
What still waits when the clean-up timer fires is dropped.  Inside one
micro-batch, where rows of the two inputs have no order, event time decides, as in
the batch form (``operators.attribution``).

Times are whole seconds, so rows are combined per (request, second) before the
shuffle: feedback to counts per kind, responses to the first and last one.  A hot
request thus sends a few rows per second and Arrow batch, and its state counts waiting
feedback likewise.

Requests are dealt to hash buckets, and a micro-batch calls the state once a bucket
rather than once a request: what a bucket keeps are tables in columns, read and written
in a few long pieces.  A touched bucket reads all it keeps, so ``buckets`` should be
such that one holds some ten thousand requests; it is fixed for a checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.fixed_values import PENDING_FEEDBACK_MINUTES
from cadenza.functions.time import local_text_to_timestamp
from cadenza.operators.attribution import INTENT
from cadenza.operators.windows import feedback_metrics, response_metrics, valid_feedback

OUTPUT = (
    "requestId string, feedbackTime string, feedbackType string, times long, "
    "intentType string, intentGroup string"
)

# the processor travels to the workers as code, so they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: rows of one stored piece, and pieces after which a table is written anew
PIECE, MOST_PIECES = 10_000, 64
#: requests are dealt to this many buckets
BUCKETS = 1024

_REQUEST_SECOND = ["requestId", "at"]
_COUNTED = [*_REQUEST_SECOND, "feedbackTime", "feedbackType"]
_OUT = ["requestId", "feedbackTime", "feedbackType", "times", *INTENT]


class Pieces:
    """A table of one bucket: a list state whose elements are pieces in columns."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, columns: dict[str, str]):
        self.columns = list(columns)
        self.state = handle.getListState(name, ", ".join(f"{c} array<{t}>" for c, t in columns.items()))

    def read(self) -> pd.DataFrame:
        pieces = list(self.state.get()) if self.state.exists() else []
        self.pieces = len(pieces)
        return pd.DataFrame({c: [v for p in pieces for v in p[i]] for i, c in enumerate(self.columns)})

    def _cut(self, rows: pd.DataFrame) -> list[tuple]:
        parts = (rows.iloc[i : i + PIECE] for i in range(0, len(rows), PIECE))
        return [tuple(part[c].tolist() for c in self.columns) for part in parts]

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.state.appendList(self._cut(rows))

    def replace(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.state.put(self._cut(rows))
        else:
            self.state.clear()

    def update(self, old: pd.DataFrame, kept: pd.DataFrame, new: pd.DataFrame) -> None:
        """``kept`` of the ``old`` rows and ``new`` ones; old pieces stay while all of them do."""
        if len(kept) == len(old) and self.pieces < MOST_PIECES:
            self.add(new)
        else:
            self.replace(pd.concat([kept, new]) if len(kept) else new)


class FeedbackAttribution(StatefulProcessor):
    """State per bucket of requests: last intents, waiting counts, clean-up timers."""

    def __init__(self, wait_ms: int, intent_ttl_ms: int | None, event_wait_seconds: int | None):
        self.wait_ms = wait_ms
        self.intent_ttl_ms = intent_ttl_ms
        self.event_wait_seconds = event_wait_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # until: wall clock in milliseconds; an intent without one (0) is kept for good
        self.intent = Pieces(
            handle, "intent", {"requestId": "string", "intentType": "string", "intentGroup": "string", "until": "long"}
        )
        self.waiting = Pieces(
            handle, "waiting",
            {
                "requestId": "string", "at": "long", "feedbackTime": "string", "feedbackType": "string",
                "times": "long", "until": "long",
            },
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        answered, given = _gathered(rows)
        first = answered.drop_duplicates("requestId").rename(columns={"at": "_answered"})
        first = first[["requestId", "_answered", *INTENT]]
        out = []

        waiting = self.waiting.read()
        ended = waiting["requestId"].isin(first["requestId"])
        if ended.any():
            out.append(self._in_time(waiting[ended].merge(first, on="requestId")))
        kept = waiting[~ended]

        stored = self.intent.read()
        alive = stored[(stored["until"] == 0) | (stored["until"] > now)]
        if len(given):
            # the last response before, of this micro-batch; else the intent known; else the next response
            given = given.sort_values("at", kind="stable")
            last = answered.drop_duplicates(_REQUEST_SECOND, keep="last").sort_values("at", kind="stable")
            last = last[[*_REQUEST_SECOND, *INTENT]]
            if len(last):
                found = pd.merge_asof(given, last, on="at", by="requestId")
                out.append(found[found["intentType"].notna()])
                given = found[found["intentType"].isna()].drop(columns=list(INTENT))
            known = given["requestId"].isin(alive["requestId"])
            if known.any():
                out.append(given[known].merge(alive[["requestId", *INTENT]], on="requestId"))
            given = given[~known]
            following = given["requestId"].isin(first["requestId"])
            if following.any():
                out.append(self._in_time(given[following].merge(first, on="requestId")))
            given = given[~following]
        self._keep_waiting(waiting, kept, given, now)

        if len(answered):
            newest = answered.drop_duplicates("requestId", keep="last")[["requestId", *INTENT]]
            newest = newest.assign(until=now + self.intent_ttl_ms if self.intent_ttl_ms is not None else 0)
            self.intent.update(stored, alive[~alive["requestId"].isin(newest["requestId"])], newest)
        for part in out:
            if len(part):
                yield part[_OUT]

    def _in_time(self, fed: pd.DataFrame) -> pd.DataFrame:
        limit = self.event_wait_seconds
        return fed if limit is None else fed[fed["_answered"] <= fed["at"] + limit]

    def _keep_waiting(self, before: pd.DataFrame, kept: pd.DataFrame, new: pd.DataFrame, now: int) -> None:
        """Requests that begin to wait now do so for ``wait_ms``, the others as long as they did."""
        if not len(new) and len(kept) == len(before):
            return
        until = kept.drop_duplicates("requestId").set_index("requestId")["until"]
        until = new["requestId"].map(until).fillna(now + self.wait_ms).astype("int64")
        new = new[[*_COUNTED, "times"]].assign(until=until)
        if len(new) and len(kept):
            more = pd.MultiIndex.from_frame(kept[_COUNTED]).isin(pd.MultiIndex.from_frame(new[_COUNTED]))
            both = pd.concat([kept[more], new])
            both["times"] = both.groupby(_COUNTED, sort=False)["times"].transform("sum")
            kept, new = kept[~more], both.drop_duplicates(_COUNTED)
        self.waiting.update(before, kept, new)
        # a timer serves all requests of the bucket that began to wait together
        was, now_needed = set(before["until"].tolist()), {*kept["until"].tolist(), *new["until"].tolist()}
        for at in was - now_needed:
            self.handle.deleteTimer(int(at))
        for at in now_needed - was:
            self.handle.registerTimer(int(at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self.waiting.read()
        self.waiting.replace(waiting[waiting["until"] > expiredTimerInfo.getExpiryTimeInMs()])
        return iter(())

    def close(self) -> None:
        pass


def _gathered(frames: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Responses of a bucket in order, first and last of each second; counts of its feedback."""
    parts, rows, most = [], 0, 200_000
    for frame in frames:
        parts.append(frame)
        rows += len(frame)
        if rows > most:
            parts = list(_combined([pd.concat(parts)]))
            rows = len(parts[0])
            most = 2 * rows + 200_000
    (all_,) = _combined([pd.concat(parts) if len(parts) > 1 else parts[0]])
    is_answer = all_["kind"] == 0
    return all_[is_answer], all_.loc[~is_answer, [*_COUNTED, "times"]]


def _combined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Combine the rows of each Arrow batch per request and second."""
    key = _REQUEST_SECOND
    for frame in frames:
        answered = frame[frame["kind"] == 0].sort_values(
            [*key, "tie", "intentType", "intentGroup"]
        )
        edge = ~answered.duplicated(key, keep="first") | ~answered.duplicated(key, keep="last")
        given = frame[frame["kind"] == 1]
        counts = given.groupby(_COUNTED, sort=False)["times"].transform("sum")
        given = given.assign(times=counts).drop_duplicates(_COUNTED)
        yield pd.concat([answered[edge], given])


def attribute_stream(
    responses: DataFrame,
    feedback: DataFrame,
    wait_ms: int = PENDING_FEEDBACK_MINUTES * 60_000,
    intent_ttl_ms: int | None = None,
    event_wait_seconds: int | None = None,
    tie: str = "eventId",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Counts of feedback per request, time, kind and the intent they count for.

    An intent is remembered for good, unless ``intent_ttl_ms`` bounds that (by wall
    clock, so that a replay may then attribute less); with
    ``event_wait_seconds`` waiting feedback also has to be that close to its
    response in event time.
    """
    at = F.unix_seconds(local_text_to_timestamp(F.col("when")))
    none = F.lit(None).cast("string")
    answered = responses.dropna(subset=["requestId", "responseTime", *INTENT]).select(
        "requestId",
        F.lit(0).alias("kind"),
        F.col("responseTime").alias("when"),
        F.coalesce(F.col(tie), F.lit("")).alias("tie"),
        *INTENT,
        none.alias("feedbackType"),
        F.lit(0).cast("bigint").alias("times"),
    )
    given = valid_feedback(feedback).select(
        "requestId",
        F.lit(1).alias("kind"),
        F.col("feedbackTime").alias("when"),
        F.lit("").alias("tie"),
        none.alias("intentType"),
        none.alias("intentGroup"),
        "feedbackType",
        F.lit(1).cast("bigint").alias("times"),
    )
    rows = answered.unionByName(given).withColumn("at", at).filter("at is not null")
    rows = rows.withColumnRenamed("when", "feedbackTime")
    return (
        rows.mapInPandas(_combined, rows.schema)
        .withColumn("_bucket", F.pmod(F.xxhash64("requestId"), F.lit(buckets)))
        .groupBy("_bucket")
        .transformWithStateInPandas(
            FeedbackAttribution(wait_ms, intent_ttl_ms, event_wait_seconds),
            outputStructType=OUTPUT,
            outputMode="append",
            timeMode="processingTime",
        )
    )


def intent_deltas(responses: DataFrame, feedback: DataFrame, **options) -> DataFrame:
    """Metric deltas by intent; response deltas bypass the stateful operator."""
    attributed = attribute_stream(responses, feedback, **options)
    by_feedback = feedback_metrics(attributed, *INTENT, times=F.col("times"))
    return response_metrics(responses, *INTENT).unionByName(by_feedback)
