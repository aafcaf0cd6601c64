"""Song and singer heat over large play logs: count first, enrich after.

A song has one dimension row, so counting per (window, song) before the look-up
gives the same result as enriching every play, while only the counts meet the
join.  The counts combine on the map side, so a hit song that holds a large part
of the log is one row per task and window, and the join never sees its plays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.fixed_values import BOARD_SIZE, WINDOW_LENGTH
from cadenza.functions.time import millis_to_timestamp
from cadenza.operators.boards import SINGER_BOARD, SONG_BOARD, best
from cadenza.operators.enrich import add_song
from cadenza.operators.windows import EVENT_TIME, play_times, to_serving, window_bounds


def _counts(plays: DataFrame, length: str) -> DataFrame:
    timed = play_times(plays)
    return timed.groupBy(F.window(EVENT_TIME, length).alias("window"), "songId").agg(
        F.count(F.lit(1)).alias("playCount")
    )


def song_heat(plays: DataFrame, songs: DataFrame, length: str = WINDOW_LENGTH) -> DataFrame:
    """Same rows as ``song_hot(add_song(plays, songs))``."""
    named = add_song(_counts(plays, length), songs, "songName")
    return named.select("songId", "songName", "playCount", *window_bounds())


def singer_heat(plays: DataFrame, songs: DataFrame, length: str = WINDOW_LENGTH) -> DataFrame:
    """Same rows as ``singer_hot(add_song(plays, songs))``."""
    named = add_song(_counts(plays, length), songs, "singerInfo").filter("singerInfo != ''")
    total = named.groupBy("window", "singerInfo").agg(F.sum("playCount").alias("playCount"))
    return total.select("singerInfo", "playCount", *window_bounds())


def _newest_plays(
    plays: DataFrame, songs: DataFrame, condition: str, length: str
) -> DataFrame:
    """Plays of the newest window that reaches the serving table.

    To find it, only the last play of each song meets the dimension; everything
    older than that window is filtered out before any aggregation.  A later window holds only plays without
    a dimension row, which never reach the serving table.
    """
    known = songs.filter(f"source_id != '' and {condition}").select(
        F.col("source_id").alias("songId")
    )
    last = play_times(plays).groupBy("songId").agg(F.max("timestamp").alias("timestamp"))
    served = last.join(known, "songId", "left_semi")
    newest = served.agg(F.max("timestamp").alias("t")).select(
        F.unix_millis(F.window(millis_to_timestamp(F.col("t")), length)["start"])
    ).scalar()
    return plays.filter(F.col("timestamp") >= newest)


def latest_top_songs(
    plays: DataFrame, songs: DataFrame, rows: int = BOARD_SIZE, length: str = WINDOW_LENGTH
) -> DataFrame:
    """Top songs of the newest served window straight from the play log."""
    newest = _newest_plays(plays, songs, "name is not null", length)
    served = to_serving(song_heat(newest, songs, length), "dm_song_hot_10s")
    return best(served, SONG_BOARD, rows)


def latest_top_singers(
    plays: DataFrame, songs: DataFrame, rows: int = BOARD_SIZE, length: str = WINDOW_LENGTH
) -> DataFrame:
    newest = _newest_plays(plays, songs, "singer_info != ''", length)
    served = to_serving(singer_heat(newest, songs, length), "dm_singer_hot_10s")
    return best(served, SINGER_BOARD, rows)
