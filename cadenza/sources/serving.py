"""Serving tables: window results by date, with a manifest of what each segment has.

Every micro-batch adds one segment, with a folder per date of ``window_end``.  The
manifest keeps the greatest ``window_end`` of each (segment, date), so the newest
window is found without a scan, and is read from the files of one date that hold it.
Compaction gives a date with many small segments a single one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.sources import files, manifests
from cadenza.sources.manifests import Manifests

SEGMENT, DATE = "_segment", "_date"
#: microseconds since the epoch, in the session's time zone; all tables use UTC
_MICROS = "unix_micros(cast(window_end AS timestamp))"


@dataclass(frozen=True)
class ServingTable:
    """Rows with ``window_start`` and ``window_end``, written in batches."""

    spark: SparkSession
    path: str

    @property
    def log(self) -> Manifests:
        return Manifests(self.spark, self.path)

    # --- writing -------------------------------------------------------------

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Add a micro-batch, once however often it is replayed."""
        run, segment = manifests.batch_of(self.spark, batch_id)
        if manifests.is_applied(self.log.load(), run, batch_id):
            return
        schema = rows.schema.json()
        held = self._write(rows, segment)

        def added(old: dict | None) -> dict:
            old = old or {"segments": {}, "applied": {}}
            return {
                **old, "schema": schema, "segments": {**old["segments"], segment: held},
                "applied": manifests.with_applied(old, run, batch_id),
            }

        self.log.commit(added)

    def _write(self, rows: DataFrame, segment: str) -> dict[str, int]:
        """Write a segment; the greatest window end of each of its dates."""
        path = f"{self.path}/{SEGMENT}={segment}"
        dated = rows.withColumn(DATE, F.to_date("window_end"))
        sorted_rows = dated.repartition(DATE).sortWithinPartitions(DATE, F.col("window_end").desc())
        sorted_rows.write.mode("overwrite").partitionBy(DATE).parquet(path)
        if not any(n.startswith(f"{DATE}=") for n in files.folders(self.spark, path)):
            return {}
        # a few numbers per date; Parquet's row group statistics would do as well
        ends = self.spark.read.schema(dated.schema).parquet(path).groupBy(F.col(DATE).cast("string").alias("d")).agg(
            F.max(F.expr(_MICROS)).alias("end")
        )
        return {r["d"]: r["end"] for r in ends.collect()}

    # --- reading -------------------------------------------------------------

    def _load(self, known: dict, paths: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(known["schema"]))
        dated = T.StructType([*schema.fields, T.StructField(DATE, T.DateType())])
        if not paths:
            return self.spark.createDataFrame([], dated)
        reader = self.spark.read.schema(dated).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/{p}" for p in paths]).select(*dated.names)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest, or an older, version."""
        known = self.log.load(version)
        if known is None:
            raise ValueError(f"no serving table {self.path}")
        paths = [f"{SEGMENT}={s}/{DATE}={d}" for s, dates in known["segments"].items() for d in dates]
        return self._load(known, paths).drop(DATE)

    def newest_window(self) -> DataFrame:
        """The rows of the greatest ``window_end``: files of one date that hold it."""
        known = self.log.load()
        if known is None:
            raise ValueError(f"no serving table {self.path}")
        ends = [(end, d, s) for s, dates in known["segments"].items() for d, end in dates.items()]
        if not ends:
            return self._load(known, []).drop(DATE)
        newest, date, _ = max(ends)
        holders = [f"{SEGMENT}={s}" for end, _, s in ends if end == newest]
        rows = self._load(known, holders)
        at = F.timestamp_micros(F.lit(newest)).cast(rows.schema["window_end"].dataType)
        return rows.filter((F.col(DATE) == F.lit(date).cast("date")) & (F.col("window_end") == at)).drop(DATE)

    # --- upkeep --------------------------------------------------------------

    def compact(self, least: int = 100) -> list[str]:
        """Give every date that has at least ``least`` segments a single one; which dates."""
        known = self.log.load()
        if known is None:
            return []
        of_date: dict[str, list[str]] = {}
        for segment, dates in known["segments"].items():
            for date in dates:
                of_date.setdefault(date, []).append(segment)
        due = {d: s for d, s in of_date.items() if len(s) >= max(2, least)}
        if not due:
            return []
        segment = f"m-{known['version']:012d}-{uuid.uuid4().hex[:8]}"
        paths = [f"{SEGMENT}={s}/{DATE}={d}" for d, segments in due.items() for s in segments]
        held = self._write(self._load(known, paths).drop(DATE), segment)

        def merged(now: dict | None) -> dict | None:
            kept = {}
            for name, dates in now["segments"].items():
                left = {d: e for d, e in dates.items() if name not in due.get(d, ())}
                if left:
                    kept[name] = left
            gone = {(s, d) for d, segments in due.items() for s in segments}
            if not gone <= {(s, d) for s, dates in now["segments"].items() for d in dates}:
                return None  # another compaction was faster
            return {**now, "segments": {**kept, segment: held}}

        return sorted(due) if self.log.commit(merged) else []

    def expire(self, keep: int = 3) -> None:
        """Forget all but the newest ``keep`` versions, and delete what only those had."""
        self.log.expire(keep, lambda m: set(m["segments"]), SEGMENT)


def serving_sink(table: ServingTable) -> Callable[[DataFrame, int], None]:
    """A sink of micro-batches for :meth:`cadenza.streaming.jobs.Warehouse.start`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.write(batch, batch_id)

    return write
