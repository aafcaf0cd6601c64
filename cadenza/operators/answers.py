"""Questions and feedback: request checks, classification, answers, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza import fixed_values as V
from cadenza.functions import questions as Q
from cadenza.functions.once import evaluated_once
from cadenza.functions.text import has_text


def query_request_reason() -> Column:
    """Why a question request (``userId, queryText``) is refused; NULL if it is not."""
    return F.when(F.col("userId").isNull(), "userId" + V.MUST_NOT_BE_EMPTY).when(
        ~has_text("queryText"), "queryText" + V.MUST_NOT_BE_EMPTY
    )


def feedback_request_reason() -> Column:
    """Why a feedback request is refused; NULL if it is not."""
    def empty(name: str) -> Column:
        missing = F.col(name).isNull() if name == "userId" else ~has_text(name)
        return F.when(missing, name + V.MUST_NOT_BE_EMPTY)

    return F.coalesce(*[empty(n) for n in ("requestId", "sessionId", "userId", "feedbackType")])


def classify(
    queries: DataFrame, text: str = "queryText", rules: Q.QuestionRules = Q.DEFAULT_RULES
) -> DataFrame:
    """Add ``intentType, intentGroup, rowLimit, singerName`` to each question."""
    normal = queries.withColumn("_q", Q.normalize_question(text))
    q = F.col("_q")
    typed = normal.withColumns(
        {
            "intentType": Q.intent_type(q, rules),
            "rowLimit": Q.row_limit(q, rules),
            "_singer": Q.asked_singer(q, rules),
        }
    )
    intent = F.col("intentType")
    return typed.withColumns(
        {
            "intentGroup": Q.intent_group(intent),
            "singerName": F.when(intent == V.SINGER_RECOMMEND, F.col("_singer")),
        }
    ).drop("_q", "_singer")


def _ranked(board: DataFrame, rows: int, *columns: str) -> Column:
    """The best ``rows`` rows of a board as one array, best first."""
    rank = (-F.col("playCount")).alias("rank")
    top = board.orderBy(rank, *columns).limit(rows)
    return top.agg(F.array_sort(F.array_agg(F.struct(rank, *columns)))).scalar()


def _sentence(parts: tuple[str, str, str], names: Column) -> Column:
    head, middle, tail = parts
    return F.concat(
        F.lit(head), F.size(names).cast("string"), F.lit(middle),
        F.array_join(names, V.LIST_SEPARATOR), F.lit(tail),
    )


def answer(
    classified: DataFrame,
    song_board: DataFrame,
    singer_board: DataFrame,
    rules: Q.QuestionRules = Q.DEFAULT_RULES,
) -> DataFrame:
    """Answer each classified question from the two boards (see ``boards``).

    The best ``rules.max_rows`` rows of each, the most that a question classified
    by these rules may ask for, become one value that every question slices by its
    own limit, so questions are neither shuffled nor joined.  The boards must be of
    that size.  Adds ``answerText, success, responseSource, resultSongIds,
    resultSingerNames``.
    """
    songs = _ranked(song_board, rules.max_rows, "songId", "songName")
    singers = _ranked(singer_board, rules.max_rows, "singerInfo")
    limit = F.col("rowLimit")
    with_rows = evaluated_once(
        classified,
        {
            "_songs": F.slice(songs, F.lit(1), limit),
            "_singers": F.slice(singers, F.lit(1), limit),
        },
    )

    asks_song = F.col("intentType") == V.HOT_SONG_QUERY
    asks_singer = F.col("intentType") == V.HOT_SINGER_QUERY
    has_songs = asks_song & (F.size("_songs") > 0)
    has_singers = asks_singer & (F.size("_singers") > 0)
    opening, closing = V.SONG_QUOTES
    titles = F.transform(
        "_songs", lambda s: F.concat(F.lit(opening), s["songName"], F.lit(closing))
    )
    singer_names = F.transform("_singers", lambda s: s["singerInfo"])
    before, after = V.SINGER_UNSUPPORTED
    recommend = F.when(
        F.col("singerName").isNotNull(), F.concat(F.lit(before), F.col("singerName"), F.lit(after))
    ).otherwise(V.SINGER_UNSUPPORTED_NO_NAME)
    text = (
        F.when(has_songs, _sentence(V.HOT_SONG_ANSWER, titles))
        .when(asks_song, V.NO_SONG_BOARD)
        .when(has_singers, _sentence(V.HOT_SINGER_ANSWER, singer_names))
        .when(asks_singer, V.NO_SINGER_BOARD)
        .when(F.col("intentType") == V.SINGER_RECOMMEND, recommend)
        .when(F.col("intentType") == V.SCENARIO_RECOMMEND, V.SCENARIO_UNSUPPORTED)
        .otherwise(V.OTHER_UNSUPPORTED)
    )
    nothing = F.array().cast("array<string>")
    return with_rows.withColumns(
        {
            "answerText": text,
            "success": has_songs | has_singers,
            "responseSource": F.lit(V.RESPONSE_SOURCE),
            "resultSongIds": F.when(
                has_songs, F.transform("_songs", lambda s: s["songId"])
            ).otherwise(nothing),
            "resultSingerNames": F.when(has_singers, singer_names).otherwise(nothing),
        }
    ).drop("_songs", "_singers")


def _generated(given: Column, seed: Column | None) -> Column:
    """A random id, or with ``seed`` one that is the same on every run."""
    fresh = F.uuid() if seed is None else F.md5(seed)
    return F.when(has_text(given), given).otherwise(fresh)


def with_session(queries: DataFrame, seed: Column | None = None) -> DataFrame:
    """Replace a blank ``sessionId`` by a generated one."""
    return queries.withColumn("sessionId", _generated(F.col("sessionId"), seed))


def _envelope(
    rows: DataFrame, kind: str, event_id: Column, event_time: Column, payload: list[Column]
) -> DataFrame:
    return rows.select(
        F.to_json(
            F.struct(
                event_id.alias("eventId"),
                F.lit(kind).alias("eventType"),
                event_time.alias("eventTime"),
                F.col("requestId").alias("requestId"),
                F.col("sessionId").alias("sessionId"),
                F.col("userId").alias("userId"),
                F.struct(*payload).alias("payload"),
            )
        ).alias("value")
    )


def query_events(queries: DataFrame, event_id: Column, event_time: Column) -> DataFrame:
    """Log messages of classified questions."""
    return _envelope(
        queries, V.AI_QUERY, event_id, event_time,
        [
            F.col("queryText").alias("queryText"), F.col("intentType").alias("intentType"),
            F.col("intentGroup").alias("intentGroup"), event_time.alias("queryTime"),
        ],
    )


def response_events(answers: DataFrame, event_id: Column, event_time: Column) -> DataFrame:
    """Log messages of answers; the frame also has ``latencyMs``."""
    return _envelope(
        answers, V.AI_RESPONSE, event_id, event_time,
        [
            *[
                F.col(c).alias(c)
                for c in (
                    "intentType", "intentGroup", "answerText", "success", "latencyMs",
                    "responseSource",
                )
            ],
            F.lit(V.MODEL_NAME).alias("modelName"),
            F.lit(V.PROMPT_TEMPLATE_ID).alias("promptTemplateId"),
            F.col("resultSongIds").alias("resultSongIds"),
            F.col("resultSingerNames").alias("resultSingerNames"),
            event_time.alias("responseTime"),
        ],
    )


def feedback_events(requests: DataFrame, event_id: Column, event_time: Column) -> DataFrame:
    return _envelope(
        requests, V.AI_FEEDBACK, event_id, event_time,
        [F.col("feedbackType").alias("feedbackType"), event_time.alias("feedbackTime")],
    )
