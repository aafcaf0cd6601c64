"""Look-up joins of facts with dimension snapshots.

All are left outer, and none carries a broadcast hint: the planner broadcasts a
dimension only below ``spark.sql.autoBroadcastJoinThreshold`` (checked again on
the real size at run time), and beyond it shuffles both sides, where adaptive
execution splits the partitions of a hot key on the fact side.  Dimensions have
one row per key (see ``changes.latest_changes``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.json import as_int, as_long, parse_object
from cadenza.functions.once import evaluated_once

SONG_COLUMNS = {
    "name": "songName",
    "album": "album",
    "singer_info": "singerInfo",
    "post_time": "postTime",
    "authorized_company": "authorizedCompany",
}


def add_song(plays: DataFrame, songs: DataFrame, *columns: str) -> DataFrame:
    """Song columns by ``songId``; a blank or unknown song passes with NULLs.

    ``columns`` (output names) narrows what is fetched.
    """
    wanted = {s: t for s, t in SONG_COLUMNS.items() if not columns or t in columns}
    dim = songs.filter("source_id != ''").select(
        F.col("source_id").alias("_song"), *[F.col(s).alias(t) for s, t in wanted.items()]
    )
    facts = plays.drop(*wanted.values())
    return facts.join(dim, F.col("songId") == F.col("_song"), "left").drop("_song")


_CONSUME_FIELDS = (
    "id", "mid", "uid", "amount", "pkg_id", "pkg_name", "activity_id", "activity_name",
    "action_time", "bill_date", "type", "ts",
)


def parse_consume(messages: DataFrame, value: str = "value") -> DataFrame:
    """Consume rows out of routed change messages."""
    row = evaluated_once(messages, {"r": parse_object(F.col(value), _CONSUME_FIELDS)})
    return row.select(
        as_long(F.col("r.id")).alias("id"),
        as_long(F.col("r.mid")).alias("mid"),
        as_long(F.col("r.uid")).alias("uid"),
        as_long(F.col("r.amount")).alias("amount"),
        as_int(F.col("r.pkg_id")).alias("pkgId"),
        F.col("r.pkg_name").alias("pkgName"),
        as_int(F.col("r.activity_id")).alias("activityId"),
        F.col("r.activity_name").alias("activityName"),
        F.col("r.action_time").alias("actionTime"),
        F.col("r.bill_date").alias("billDate"),
        F.col("r.type").alias("type"),
        as_long(F.col("r.ts")).alias("ts"),
    )


def valid_consume(rows: DataFrame) -> DataFrame:
    """Complete rows of real inserts: updates and snapshots are no revenue."""
    return rows.dropna(subset=["mid", "amount", "actionTime"]).filter("type = 'insert'")


def consume_base(rows: DataFrame) -> DataFrame:
    return rows.drop("type", "ts")


def add_machine(
    rows: DataFrame, machines: DataFrame, admin: DataFrame | None = None
) -> DataFrame:
    """Province and city by machine; with ``admin`` also name, package and rates."""
    dim = machines.select(F.col("mid").alias("_mid"), "province", "city")
    key = F.col("mid").cast("string")
    wide = rows.join(dim, key == F.col("_mid"), "left").drop("_mid")
    if admin is None:
        return wide
    rates = admin.select(
        F.col("machine_num").alias("_num"),
        F.col("machine_name").alias("machineName"),
        F.col("package_name").alias("packageName"),
        *[
            F.col(c).try_cast("double").alias(n)
            for c, n in (
                ("inv_rate", "invRate"), ("age_rate", "ageRate"),
                ("com_rate", "comRate"), ("par_rate", "parRate"),
            )
        ],
    )
    return wide.join(rates, key == F.col("_num"), "left").drop("_num")


def consume_wide(rows: DataFrame, machines: DataFrame) -> DataFrame:
    return add_machine(consume_base(valid_consume(rows)), machines)


def valid_logins(logins: DataFrame) -> DataFrame:
    return logins.dropna(subset=["userId", "lng", "lat", "loginDt"])


def grid_cell(coordinate: Column, decimals: int = 3) -> Column:
    """Integer cell of a coordinate given as text: exact decimal rounding."""
    exact = coordinate.try_cast("decimal(18,9)")
    return F.round(exact * F.lit(10**decimals), 0).cast("bigint")


def add_region(logins: DataFrame, regions: DataFrame, decimals: int = 3) -> DataFrame:
    """Region of each valid login by grid cell; unknown cells get NULLs.

    ``regions`` has one row per ``lng_cell, lat_cell``.
    """
    dim = regions.select(
        F.col("lng_cell").alias("_x"),
        F.col("lat_cell").alias("_y"),
        *[F.col(c).alias(c) for c in ("province", "city", "district", "adcode")],
    )
    facts = valid_logins(logins)
    on = (grid_cell(F.col("lng"), decimals) == F.col("_x")) & (
        grid_cell(F.col("lat"), decimals) == F.col("_y")
    )
    return facts.join(dim, on, "left").drop("_x", "_y")
