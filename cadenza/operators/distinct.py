"""Exact distinct users whose partial results can be merged.

A set of users is kept as 64-bit words: user number ``u`` is bit ``u mod 64`` of word
``u div 64``.  Words of one set are combined by OR, which may be done in any order,
over any number of parts, and again for rows that were counted before, so parts of
micro-batches can simply be appended.  Short windows merge into longer ones without
the log.  All steps are hash aggregates over long values, combined before the
shuffle; a stored word takes 8 bytes and stands for up to 64 users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.fixed_values import WINDOW_LENGTH
from cadenza.operators.windows import REGION, window_bounds, with_millis

KIND, USERS, CODES = "part", "users", "codes"


def user_word() -> Column:
    return F.shiftright(F.col("userId").cast("long"), 6)


def user_bits() -> Column:
    """The users of a group as bits of their common word."""
    return F.bit_or(F.expr("shiftleft(1L, cast(pmod(cast(userId AS bigint), 64) AS int))"))


def login_parts(wide: DataFrame, length: str = WINDOW_LENGTH) -> DataFrame:
    """Mergeable parts of region logins per window: words of users, first login per adcode.

    Columns ``window_start``, the region, ``part``, ``word`` and ``bits`` of the users,
    ``adcode`` and ``first_login``.
    """
    rows = with_millis(wide.dropna(subset=["userId", "loginDt", *REGION]), "loginDt", None)
    at = rows.withColumn("window_start", F.window("eventTs", length)["start"])
    words = at.withColumn("word", user_word()).groupBy("window_start", *REGION, "word").agg(user_bits().alias("bits"))
    codes = at.groupBy("window_start", *REGION, "adcode").agg(F.min("loginDt").alias("first_login"))
    return words.withColumn(KIND, F.lit(USERS)).unionByName(
        codes.withColumn(KIND, F.lit(CODES)), allowMissingColumns=True
    )


def login_totals(parts: DataFrame, length: str) -> DataFrame:
    """Region logins per window of ``length`` out of stored parts of shorter windows.

    ``length`` must be a multiple of theirs.
    """
    at = parts.withColumn("window", F.window("window_start", length))
    return totals(at.filter(F.col(KIND) == USERS), at.filter(F.col(KIND) == CODES))


def totals(words: DataFrame, codes: DataFrame) -> DataFrame:
    """Users and adcode of the earliest login per ``window`` and region.

    ``words`` has ``word`` and ``bits``, ``codes`` has ``adcode`` and ``first_login``.
    Text is only compared among the few adcodes of a region.
    """
    keys = ["window", *REGION]
    merged = words.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))
    users = merged.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("long").alias("loginUserCount"))
    few = codes.groupBy(*keys, "adcode").agg(F.min("first_login").alias("loginDt"))
    first = few.groupBy(*keys).agg(F.min(F.struct("loginDt", "adcode")).alias("first"))
    return users.join(first, keys).select(
        *REGION, F.col("first.adcode").alias("adcode"), "loginUserCount", *window_bounds()
    )
