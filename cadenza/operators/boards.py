"""Reads of the newest window: top songs and top singers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.fixed_values import BOARD_SIZE
from cadenza.functions.time import timestamp_to_text

SONG_BOARD = {"song_id": "songId", "song_name": "songName"}
SINGER_BOARD = {"singer_info": "singerInfo"}


def newest_window(serving: DataFrame) -> DataFrame:
    """Rows of the greatest ``window_end`` (an uncorrelated scalar subquery)."""
    newest = serving.agg(F.max("window_end")).scalar()
    return serving.filter(F.col("window_end") == newest)


def best(serving: DataFrame, names: dict[str, str], rows: int = BOARD_SIZE) -> DataFrame:
    """Most played first, ties by key; planned as one top-k per task and a merge."""
    order: list[Column] = [F.col("play_count").desc(), *[F.col(c) for c in names]]
    return serving.orderBy(*order).limit(rows).select(
        timestamp_to_text(F.col("window_start")).alias("windowStart"),
        timestamp_to_text(F.col("window_end")).alias("windowEnd"),
        *[F.col(s).alias(t) for s, t in names.items()],
        F.col("play_count").alias("playCount"),
    )


def top_songs(serving: DataFrame, rows: int = BOARD_SIZE) -> DataFrame:
    return best(newest_window(serving), SONG_BOARD, rows)


def top_singers(serving: DataFrame, rows: int = BOARD_SIZE) -> DataFrame:
    return best(newest_window(serving), SINGER_BOARD, rows)
