"""Places that a geocoder has resolved, kept so that none is asked again.

A bucketed dimension store with one row per place: its region, or how often its run
was refused.  A place is asked if it is in no row, or was refused fewer than
``most_tries`` times; a place that was answered, with a region or without, is settled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.fixed_values import GEOCODE_BATCH_SIZE
from cadenza.functions.text import location_key
from cadenza.operators import geocode
from cadenza.operators.enrich import valid_logins
from cadenza.sources.dimensions import DimensionStore

TABLE, KEY = "PLACES", "place"
_REGION = ("province", "city", "district", "adcode")
_COLUMNS = (*_REGION, "state", "tries")
SETTLED, REFUSED = "settled", "refused"


@dataclass(frozen=True)
class PlaceStore:
    store: DimensionStore
    most_tries: int = 3
    #: segments after which the store is merged
    compact_after: int = 32

    def read(self) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in (KEY, *_COLUMNS))
        spark = self.store.spark
        if not self.store.versions(TABLE):
            return spark.createDataFrame([], schema)
        return self.store.read(TABLE).select(KEY, *_COLUMNS)

    def resolve(
        self, logins: DataFrame, resolver: geocode.Resolver, batch_id: int, batch_size: int = GEOCODE_BATCH_SIZE
    ) -> DataFrame:
        """Logins with their regions; only places that are not settled are asked.

        The answers are stored before they are used, so a replayed micro-batch finds
        them there.  A place that was refused too often keeps a NULL region.
        """
        facts = valid_logins(logins).withColumn("_key", location_key("lng", "lat"))
        known = self.read()
        done = known.filter((F.col("state") == SETTLED) | (F.col("tries").cast("int") >= self.most_tries))
        open_places = facts.select("_key").distinct().join(done.select(F.col(KEY).alias("_key")), "_key", "left_anti")
        asked = geocode.ask_places(open_places, resolver, batch_size)
        before = known.select(F.col(KEY).alias("_key"), F.col("tries").cast("int").alias("_before"))
        rows = asked.join(before, "_key", "left").withColumn("_tries", F.coalesce("_before", F.lit(0)) + 1)
        values = {c: F.col(c) for c in _REGION} | {
            "state": F.when(F.col("_answered"), SETTLED).otherwise(REFUSED), "tries": F.col("_tries").cast("string"),
        }
        data = F.create_map(*[x for c, v in values.items() for x in (F.lit(c), v)])
        changed = rows.select(
            F.lit(TABLE).alias("phoenix_table_name"), F.col("_key").alias("pk"), F.lit("update").alias("type"),
            F.lit(",".join(_COLUMNS)).alias("cols"), data.alias("data"), F.lit(batch_id).cast("long").alias("seq"),
        ).persist()
        try:
            config = logins.sparkSession.createDataFrame(
                [(TABLE, KEY, ",".join(_COLUMNS))], "phoenix_tbl_name string, pk_col string, cols string"
            )
            self.store.apply(changed, config, batch_id)
        finally:
            changed.unpersist()
        self.store.compact(TABLE, self.compact_after)
        # the store writes a missing value as empty text
        region = [F.when(F.col("state") == SETTLED, F.nullif(F.col(c), F.lit(""))).alias(c) for c in _REGION]
        regions = self.read().select(F.col(KEY).alias("_key"), *region)
        return facts.join(regions, "_key", "left").drop("_key")
