"""Region aggregates over large logs: reduce per machine or grid cell first.

A machine and a grid cell have one region each, so facts are reduced per (window,
machine) or (window, cell, word of users) before the look-up; the results are the same as
those of the row-level operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.fixed_values import WINDOW_LENGTH
from cadenza.functions.time import local_text_to_timestamp
from cadenza.operators import distinct
from cadenza.operators.enrich import add_machine, grid_cell, valid_consume, valid_logins
from cadenza.operators.windows import (
    EVENT_TIME, REGION, window_bounds, with_event_time, with_millis,
)


def region_revenue(
    consume: DataFrame, machines: DataFrame, length: str = WINDOW_LENGTH
) -> DataFrame:
    """Same rows as ``windows.region_revenue(consume_wide(consume, machines))``."""
    rows = with_event_time(
        valid_consume(consume), local_text_to_timestamp(F.col("actionTime")), None
    )
    per_machine = rows.groupBy(F.window(EVENT_TIME, length).alias("window"), "mid").agg(
        F.count(F.lit(1)).alias("orderCount"), F.sum("amount").alias("totalAmount")
    )
    placed = add_machine(per_machine, machines).dropna(subset=["province", "city"])
    total = placed.groupBy("window", "province", "city").agg(
        F.sum("orderCount").alias("orderCount"), F.sum("totalAmount").alias("totalAmount")
    )
    return total.select("province", "city", "orderCount", "totalAmount", *window_bounds())


def region_login(
    logins: DataFrame, regions: DataFrame, length: str = WINDOW_LENGTH, decimals: int = 3
) -> DataFrame:
    """Same rows as ``windows.region_login(add_region(logins, regions))``."""
    rows = with_millis(valid_logins(logins), "loginDt", None)
    per_cell = rows.groupBy(
        F.window(EVENT_TIME, length).alias("window"),
        grid_cell(F.col("lng"), decimals).alias("lng_cell"),
        grid_cell(F.col("lat"), decimals).alias("lat_cell"),
        distinct.user_word().alias("word"),
    ).agg(distinct.user_bits().alias("bits"), F.min("loginDt").alias("first_login"))
    placed = per_cell.join(regions, ["lng_cell", "lat_cell"]).dropna(subset=list(REGION))
    return distinct.totals(placed, placed)
