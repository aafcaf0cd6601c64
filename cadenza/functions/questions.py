"""Rules that classify a question; keyword table and patterns are parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza import fixed_values as V
from cadenza.functions.text import strip_whitespace, trim_all


@dataclass(frozen=True)
class QuestionRules:
    """What to look for, in this order: singers, songs, recommendations."""

    hot_singer_words: Sequence[str] = V.HOT_SINGER_WORDS
    hot_song_words: Sequence[str] = V.HOT_SONG_WORDS
    recommend_words: Sequence[str] = V.RECOMMEND_WORDS
    singer_pattern: str = V.SINGER_PATTERN
    limit_pattern: str = V.LIMIT_PATTERN
    default_rows: int = V.DEFAULT_ANSWER_ROWS
    min_rows: int = V.MIN_ANSWER_ROWS
    max_rows: int = V.MAX_ANSWER_ROWS


DEFAULT_RULES = QuestionRules()


def normalize_question(c: Column | str) -> Column:
    return F.coalesce(strip_whitespace(trim_all(c)), F.lit(""))


def row_limit(question: Column, rules: QuestionRules = DEFAULT_RULES) -> Column:
    """How many rows a normalized question asks for, clamped to the allowed range."""
    digits = F.regexp_extract(question, rules.limit_pattern, 1)
    asked = F.coalesce(digits.try_cast("int"), F.lit(rules.default_rows))
    return F.least(F.greatest(asked, F.lit(rules.min_rows)), F.lit(rules.max_rows))


def asked_singer(question: Column, rules: QuestionRules = DEFAULT_RULES) -> Column:
    return F.nullif(F.regexp_extract(question, rules.singer_pattern, 1), F.lit(""))


def mentions_any(question: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | question.contains(word)
    return found


def intent_type(question: Column, rules: QuestionRules = DEFAULT_RULES) -> Column:
    return (
        F.when(mentions_any(question, rules.hot_singer_words), V.HOT_SINGER_QUERY)
        .when(mentions_any(question, rules.hot_song_words), V.HOT_SONG_QUERY)
        .when(
            mentions_any(question, rules.recommend_words),
            F.when(asked_singer(question, rules).isNotNull(), V.SINGER_RECOMMEND).otherwise(
                V.SCENARIO_RECOMMEND
            ),
        )
        .otherwise(V.OTHER_INTENT)
    )


def intent_group(intent: Column) -> Column:
    return F.when(intent.isin(V.SINGER_RECOMMEND, V.SCENARIO_RECOMMEND), V.RECOMMEND).otherwise(
        V.DATA_QA
    )
