"""Dimensions kept as buckets of base rows and segments of changes since.

Keys are dealt to hash buckets.  A micro-batch writes one segment, with files of the
buckets that it touches only; nothing is rewritten.  A manifest names the segments
that count, and the columns as far as they are known; it is replaced in one rename,
so readers see a whole batch or nothing of it.  On read the last change of every
column wins, whatever the order in which batches came.  Buckets without changes are
read as they are; only the others are merged.

Compaction is a job of its own: it merges the buckets that have changes into a new
base and leaves the other buckets alone.  It may run beside the stream, as both only
ever add a manifest, and whoever comes second starts from the other's.  The stream's
replays are known by stream and batch number and add nothing.

Where the file system's rename is not atomic (object stores), a table format should
take the place of this store.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators import changes
from cadenza.sources import files, manifests
from cadenza.sources.manifests import Manifests

SEGMENT, BUCKET = "_segment", "_bucket"


@dataclass(frozen=True)
class Manifest:
    """What a version of a dimension consists of."""

    key: str
    buckets: int
    seq: str
    columns: list[str] = field(default_factory=list)
    #: bucket -> segment with its merged rows
    base: dict[str, str] = field(default_factory=dict)
    #: segments of changes and their buckets, in the order of their commits
    changes: dict[str, list[int]] = field(default_factory=dict)
    #: stream -> greatest batch of it that is in here
    applied: dict[str, int] = field(default_factory=dict)
    version: int = 0

    @property
    def changed_buckets(self) -> list[int]:
        return sorted({b for buckets in self.changes.values() for b in buckets})

    @property
    def segments(self) -> set[str]:
        return {*self.base.values(), *self.changes}

    def stored_schema(self) -> T.StructType:
        seq = T.DataType.fromDDL(self.seq)
        schema = T.StructType()
        for name in (self.key, *self.columns):
            schema.add(name, T.StringType())
        schema.add(changes.SEQ, seq).add(changes.DELETED, seq)
        return schema.add(changes.OLDER, T.MapType(T.StringType(), seq))


@dataclass(frozen=True)
class DimensionStore:
    spark: SparkSession
    root: str
    #: buckets of dimensions that are created; an existing one keeps its number
    buckets: int = 16

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _log(self, table: str) -> Manifests:
        return Manifests(self.spark, self.path(table))

    def versions(self, table: str) -> list[int]:
        return self._log(table).versions()

    def manifest(self, table: str, version: int | None = None) -> Manifest | None:
        """The newest manifest, or that of a version."""
        known = self._log(table).load(version)
        return Manifest(**known) if known else None

    # --- reading -------------------------------------------------------------

    def read(self, table: str, schema: T.StructType | None = None, version: int | None = None) -> DataFrame:
        """The rows of a dimension; without one an empty table of ``schema``.

        Columns of ``schema`` that no change has had yet are NULL.  Called inside a
        micro-batch it shows every change applied before.
        """
        known = self.manifest(table, version)
        if known is None:
            if schema is None:
                raise ValueError(f"no dimension {table}")
            return self.spark.createDataFrame([], schema)
        rows = changes.present_rows(self.stored(table, known))
        for f in schema or ():
            if f.name.lower() not in {c.lower() for c in rows.columns}:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        return rows

    def stored(self, table: str, known: Manifest) -> DataFrame:
        """One stored row per key of a version, deleted keys included."""
        changed = {str(b) for b in known.changed_buckets}
        alone = {b: s for b, s in known.base.items() if b not in changed}
        parts = [self._load(table, known, alone, {})] if alone else []
        if known.changes:
            parts.append(self._merged(table, known))
        if not parts:
            return self.spark.createDataFrame([], known.stored_schema())
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _merged(self, table: str, known: Manifest) -> DataFrame:
        """The merged rows of all buckets with changes."""
        changed = {str(b) for b in known.changed_buckets}
        base = {b: s for b, s in known.base.items() if b in changed}
        rows = self._load(table, known, base, known.changes)
        return changes.merge_stored(rows, known.key, known.columns)

    def _load(self, table: str, known: Manifest, base: dict[str, str], more: dict[str, list[int]]) -> DataFrame:
        """Stored rows by name: a column that a file lacks is NULL."""
        root = self.path(table)
        paths = [f"{root}/{SEGMENT}={s}/{BUCKET}={b}" for b, s in base.items()]
        paths += [f"{root}/{SEGMENT}={s}" for s in more]
        return self.spark.read.schema(known.stored_schema()).option("basePath", root).parquet(*paths).select(
            *known.stored_schema().names
        )

    # --- writing -------------------------------------------------------------

    def apply(self, latest: DataFrame, config: DataFrame, batch_id: int) -> list[str]:
        """Add the changes of a micro-batch to each dimension that they concern.

        ``latest`` has the last changes of each key (``changes.last_of_each_source``, or
        ``changes.latest_changes`` where one source table feeds a dimension), with ``seq``.
        Several source tables may feed one dimension, each with the columns that its
        configuration lists; lists may change from batch to batch.  Names and lists
        of the touched dimensions come to the driver, rows do not.  ``latest`` is made
        once, however many dimensions there are, and kept on disk meanwhile.
        """
        latest = latest.persist(StorageLevel.DISK_ONLY)
        try:
            return self._apply(latest, config, batch_id)
        finally:
            latest.unpersist()

    def _apply(self, latest: DataFrame, config: DataFrame, batch_id: int) -> list[str]:
        rows = config.select("phoenix_tbl_name", "pk_col", "cols").distinct()
        touched = latest.select(F.col("phoenix_table_name").alias("phoenix_tbl_name")).distinct()
        lists: dict[str, list[tuple[str, str]]] = {}
        for table, pk_col, cols in sorted(rows.join(touched, "phoenix_tbl_name").collect()):
            lists.setdefault(table, []).append((pk_col, cols))
        for table, own in lists.items():
            self._append(latest, table, own, batch_id)
        return sorted(lists)

    def _append(self, latest: DataFrame, table: str, lists: list[tuple[str, str]], batch_id: int) -> None:
        run, segment = manifests.batch_of(self.spark, batch_id)
        known = self.manifest(table)
        if manifests.is_applied(known and asdict(known), run, batch_id):
            return
        key = known.key if known else lists[0][0]
        seq = latest.schema["seq"].dataType
        buckets = known.buckets if known else self.buckets
        columns = changes.listed_columns([*(known.columns if known else []), *[c for _, c in lists]], key)
        if known is not None and T.DataType.fromDDL(known.seq) != seq:
            latest = latest.withColumn("seq", F.col("seq").cast(known.seq))
        new = changes.stored_changes(latest, table, key, columns)
        dealt = self._write(new, table, key, buckets, segment)
        made = asdict(Manifest(key, buckets, known.seq if known else seq.simpleString()))

        def added(old: dict | None) -> dict:
            old = old or made
            return {
                **old,
                "columns": changes.listed_columns([*old["columns"], *columns], key),
                "changes": {**old["changes"], segment: dealt},
                "applied": manifests.with_applied(old, run, batch_id),
            }

        self._log(table).commit(added)

    def _write(self, rows: DataFrame, table: str, key: str, buckets: int, segment: str) -> list[int]:
        """Write a segment with one folder per bucket; which buckets it has."""
        path = f"{self.path(table)}/{SEGMENT}={segment}"
        bucket = F.pmod(F.hash(key), F.lit(buckets))
        rows.withColumn(BUCKET, bucket).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        return [int(n.split("=")[1]) for n in files.folders(self.spark, path) if n.startswith(f"{BUCKET}=")]

    # --- upkeep --------------------------------------------------------------

    def compact(self, table: str, least: int = 8) -> bool:
        """Merge the changes into the base, once there are ``least`` segments of them.

        Only buckets with changes are rewritten.  False if there was too little to do,
        or if another compaction was faster.
        """
        known = self.manifest(table)
        if known is None or len(known.changes) < max(1, least):
            return False
        segment = f"b-{known.version:012d}-{uuid.uuid4().hex[:8]}"
        dealt = self._write(self._merged(table, known), table, known.key, known.buckets, segment)

        def merged(now: dict | None) -> dict | None:
            if now is None or not set(known.changes) <= set(now["changes"]) or now["base"] != known.base:
                return None
            later = {s: b for s, b in now["changes"].items() if s not in known.changes}
            return {**now, "base": {**now["base"], **{str(b): segment for b in dealt}}, "changes": later}

        return self._log(table).commit(merged) is not None

    def expire(self, table: str, keep: int = 3) -> None:
        """Forget all but the newest ``keep`` versions, and delete what only those had."""
        self._log(table).expire(keep, lambda m: Manifest(**m).segments, SEGMENT)


class Snapshots:
    """Dimensions as they are joined, kept until a new version is there.

    A version is read once and persisted; it is dropped when the manifest has moved.
    What a lost executor held is read again.
    """

    def __init__(self):
        self._held: dict[tuple[str, str], tuple[int, DataFrame]] = {}

    def get(self, store: DimensionStore, table: str, schema: T.StructType | None = None) -> DataFrame:
        name = (store.root, table)
        known = store.versions(table)
        held = self._held.get(name)
        if held and known and held[0] == known[-1]:
            return held[1]
        if held:
            held[1].unpersist()
            del self._held[name]
        rows = store.read(table, schema, known[-1] if known else None)
        if known:
            self._held[name] = (known[-1], rows.persist())
        return rows

    def clear(self) -> None:
        for _, rows in self._held.values():
            rows.unpersist()
        self._held.clear()
