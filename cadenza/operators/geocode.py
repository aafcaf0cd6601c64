"""Reverse geocoding: archived answers, and a batch resolver given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.fixed_values import (
    GEOCODE_BATCH_SIZE, GEOCODE_OK_INFOCODE, GEOCODE_OK_STATUS,
)
from cadenza.functions.json import parse_object
from cadenza.functions.once import evaluated_once
from cadenza.functions.text import location_key, region_city, region_province
from cadenza.operators.enrich import valid_logins

#: takes location keys, gives one geocoder answer (JSON text) for the whole batch
Resolver = Callable[[Sequence[str]], str]

_PARTS = ("province", "city", "district", "adcode")


def answer_entries(answer: Column) -> Column:
    """Entries of an accepted answer as JSON texts; NULL for a refused one."""
    top = parse_object(answer, ("status", "infocode", "regeocodes"))
    accepted = (top["status"] == GEOCODE_OK_STATUS) & (top["infocode"] == GEOCODE_OK_INFOCODE)
    return F.when(accepted, F.from_json(top["regeocodes"], "array<string>"))


def parse_entry(entry: Column) -> Column:
    """Address of one entry as text fields."""
    address = parse_object(entry, ("addressComponent",)).getField("addressComponent")
    return parse_object(address, _PARTS)


def region_columns(raw: Column) -> list[Column]:
    """``province, city, district, adcode`` out of :func:`parse_entry`."""
    return [
        region_province(raw["province"]).alias("province"),
        region_city(raw["city"], raw["province"]).alias("city"),
        raw["district"].alias("district"),
        raw["adcode"].alias("adcode"),
    ]


def zip_answers(
    batches: DataFrame, points: str = "points", answer: str = "answer"
) -> DataFrame:
    """Point ``i`` of each batch with entry ``i`` of its answer; the shorter side wins.

    ``points`` is an array column of bounded length (one geocoder call).
    """
    keep = [c for c in batches.columns if c not in (points, answer)]
    pairs = F.arrays_zip(
        F.col(points).alias("point"), answer_entries(F.col(answer)).alias("entry")
    )
    both = F.filter(pairs, lambda p: p["point"].isNotNull() & p["entry"].isNotNull())
    rows = batches.select(*keep, F.inline(both))
    parsed = evaluated_once(rows, {"entry": parse_entry(F.col("entry"))})
    return parsed.select(*keep, "point", *region_columns(F.col("entry")))


def resolve_regions(
    logins: DataFrame, resolver: Resolver, batch_size: int = GEOCODE_BATCH_SIZE
) -> DataFrame:
    """Ask ``resolver`` for each run of ``batch_size`` places and add the regions.

    Every place is asked for once, however many logins it has.  The calls run in
    the tasks, one Arrow batch at a time; the last short run of a batch is asked for
    as well.  Logins without an entry in the answer get a NULL region, and so do those
    of a run that the resolver refuses or answers with something else: see
    :func:`unresolved`.
    """
    facts = valid_logins(logins).withColumn("_key", location_key("lng", "lat"))
    known = ask_places(facts.select("_key").distinct(), resolver, batch_size).drop("_answered")
    return facts.join(known, "_key", "left").drop("_key")


def ask_places(places: DataFrame, resolver: Resolver, batch_size: int = GEOCODE_BATCH_SIZE) -> DataFrame:
    """The region of each place (``_key``), and whether its run was answered at all."""
    schema = T.StructType(
        [*places.schema.fields, T.StructField("_entry", T.StringType()), T.StructField("_answered", T.BooleanType())]
    )

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for frame in frames:
            keys = frame["_key"].tolist()
            entries: list[str | None] = []
            answered: list[bool] = []
            for start in range(0, len(keys), batch_size):
                part = keys[start:start + batch_size]
                try:
                    answer = json.loads(resolver(part))
                except (TypeError, ValueError):
                    answer = None
                answer = answer if isinstance(answer, dict) else {}
                good = (
                    str(answer.get("status")) == GEOCODE_OK_STATUS
                    and str(answer.get("infocode")) == GEOCODE_OK_INFOCODE
                )
                listed = answer.get("regeocodes") if good else None
                found = [
                    json.dumps(e, ensure_ascii=False)
                    for e in (listed if isinstance(listed, list) else [])[: len(part)]
                ]
                entries += found + [None] * (len(part) - len(found))
                answered += [good] * len(part)
            yield frame.assign(_entry=pd.Series(entries, index=frame.index, dtype=object), _answered=answered)

    asked = evaluated_once(places.mapInPandas(ask, schema), {"_entry": parse_entry(F.col("_entry"))})
    return asked.select("_key", "_answered", *region_columns(F.col("_entry")))


def unresolved(resolved: DataFrame) -> DataFrame:
    """Logins of :func:`resolve_regions` without a region, with the reason."""
    return resolved.filter(F.col("province").isNull()).withColumn("reason", F.lit("no region"))
