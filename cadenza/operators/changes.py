"""Database change log: parse, route by configuration, apply to dimensions.

Rows carry an explicit order (``seq`` by default: an offset, or any orderable
column or struct), because "last wins" needs one on a distributed engine.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cadenza.fixed_values import DELETE_TYPE, UPSERT_TYPES
from cadenza.functions import text
from cadenza.functions.once import evaluated_once

_ENVELOPE = T.StructType(
    [
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("ts", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: metadata written into each routed row, over source columns of the same name
META_KEYS = ("ts", "pk_col", "cols", "phoenix_table_name", "sink_topic", "type")

#: dimension table and the clean-up of its columns before an upsert
SONG_DIMENSION = "DIM_SONG"
CLEANERS = {
    SONG_DIMENSION: {
        "singer_info": text.singer_name,
        "album": text.clean_album,
        "authorized_company": text.clean_company,
    }
}


def parse_changes(messages: DataFrame, value: str = "value") -> DataFrame:
    """Change messages as ``database, table, ts, type, data`` (a map of texts).

    Messages without ``data`` (schema changes, and text that is no JSON) are
    dropped; :func:`without_data` shows them.
    """
    keep = [c for c in messages.columns if c != value]
    parsed = evaluated_once(messages, {"m": F.from_json(F.col(value), _ENVELOPE)})
    return parsed.filter(F.col("m.data").isNotNull()).select(*keep, "m.*")


def without_data(messages: DataFrame, value: str = "value") -> DataFrame:
    data = F.from_json(F.col(value), _ENVELOPE).getField("data")
    return messages.filter(data.isNull()).withColumn("reason", F.lit("no row data"))


def latest_config(config: DataFrame, order: str | None = None) -> DataFrame:
    """One configuration row per source table; the last one wins.

    Without an order column the greatest row (all columns compared) is taken, so
    the choice is at least the same on every run.
    """
    by = [F.col(order).desc()] if order else [F.struct(*config.columns).desc()]
    newest = Window.partitionBy("tbl_db", "tbl_name").orderBy(*by)
    return (
        config.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    )


def with_known_size(config: DataFrame, rows: int = 10_000) -> DataFrame:
    """``config`` as a local table if it has at most ``rows`` rows, otherwise as it is.

    Sources such as databases report no size, and the planner would then shuffle the
    log, or send it to the tasks, to meet a few rows of configuration.
    """
    some = config.take(rows + 1)
    if len(some) > rows:
        return config
    columns = [
        pa.array([r[i] for r in some], to_arrow_type(f.dataType)) for i, f in enumerate(config.schema)
    ]
    local = pa.table(columns, names=config.columns)
    return config.sparkSession.createDataFrame(local, config.schema)


def route_changes(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Attach the configuration of each row's source table (inner join).

    ``config`` has one row per table (:func:`latest_config`).  No hint is given:
    the planner broadcasts it when its size is below the session's threshold.
    """
    names = config.select(
        F.col("tbl_db").alias("database"),
        F.col("tbl_name").alias("table"),
        "pk_col",
        "cols",
        F.col("phoenix_tbl_name").alias("phoenix_table_name"),
        "sink_topic",
    )
    joined = changes.join(names, ["database", "table"])
    # a doubled key keeps its last value, as in a map that is filled in order
    entries = F.map_entries("data")

    def last_of_its_key(entry: Column, i: Column) -> Column:
        later = F.slice(F.map_keys("data"), i + 2, F.greatest(F.size("data") - i - 1, F.lit(0)))
        return ~entry["key"].isin(*META_KEYS) & ~F.array_contains(later, entry["key"])

    own = F.filter(entries, last_of_its_key)
    meta = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in META_KEYS])
    return joined.withColumn("data", F.map_from_entries(F.concat(own, meta)))


def with_topic(routed: DataFrame) -> DataFrame:
    """``topic`` and ``value`` per row; rows without a topic are left out."""
    return routed.filter(F.coalesce(F.col("sink_topic") != "", F.lit(False))).select(
        F.col("sink_topic").alias("topic"), F.to_json("data").alias("value")
    )


def without_topic(routed: DataFrame) -> DataFrame:
    return routed.filter(~F.coalesce(F.col("sink_topic") != "", F.lit(False))).withColumn(
        "reason", F.lit("no sink topic")
    )


def primary_key() -> Column:
    """Value of the row's configured key column (missing gives NULL)."""
    return F.try_element_at("data", F.col("pk_col"))


def applicable(routed: DataFrame) -> DataFrame:
    """Rows that change a dimension: known operation and a key."""
    return routed.withColumn("pk", primary_key()).filter(
        F.col("type").isin(*UPSERT_TYPES, DELETE_TYPE) & F.col("pk").isNotNull()
    )


def latest_changes(
    rows: DataFrame,
    keys: Sequence[str] = ("phoenix_table_name", "pk"),
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """The last change of each key, deletes included.

    The ``row_number = 1`` filter is planned with a group limit *before* the
    shuffle, so each map task sends at most one row per key: a key that holds a
    large part of the log costs no more than any other.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def live_rows(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("type") != DELETE_TYPE)


def column_names(cols: str) -> list[str]:
    """Configured column list: split at commas, trimmed."""
    return [c.strip() for c in cols.split(",")]


def dimension_schema(pk_col: str, cols: str) -> T.StructType:
    """All columns are text; the key comes first."""
    names = [pk_col, *[c for c in column_names(cols) if c != pk_col]]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def dimension_rows(
    latest: DataFrame, table: str, pk_col: str, cols: str, *more: Column
) -> DataFrame:
    """Rows of one dimension out of :func:`live_rows`; a missing column is ``''``.

    ``more`` are further columns, taken as they are.
    """
    cleaners = CLEANERS.get(table, {})

    def column(name: str) -> Column:
        raw = F.try_element_at("data", F.lit(name))
        cleaned = cleaners[name](raw) if name in cleaners else raw
        return F.coalesce(cleaned, F.lit("")).alias(name)

    others = [f.name for f in dimension_schema(pk_col, cols) if f.name != pk_col]
    return latest.filter(F.col("phoenix_table_name") == table).select(
        F.col("pk").alias(pk_col), *[column(n) for n in others], *more
    )


def apply_changes(
    snapshot: DataFrame | None, latest: DataFrame, table: str, pk_col: str, cols: str
) -> DataFrame:
    """New snapshot of one dimension: old rows not touched, and the upserted ones."""
    upserts = dimension_rows(live_rows(latest), table, pk_col, cols)
    if snapshot is None:
        return upserts
    touched = latest.filter(F.col("phoenix_table_name") == table).select(
        F.col("pk").alias(pk_col)
    )
    return snapshot.join(touched, pk_col, "left_anti").unionByName(upserts)


#: of a stored row: position of its last upsert, of its last deletion, and the
#: positions of columns that are older than the upsert
SEQ, DELETED, OLDER = "_seq", "_deleted", "_older"



def last_of_each_source(rows: DataFrame) -> DataFrame:
    """The last upsert and the last deletion of each source table and key.

    Enough for :func:`merge_stored`: an upsert replaces all columns of the earlier
    ones of its source; a deletion may take columns of other sources with it, even
    where its own source has written the row again.
    """
    marked = rows.withColumn("_deletes", F.col("type") == DELETE_TYPE)
    keys = ("phoenix_table_name", "database", "table", "pk", "_deletes")
    return latest_changes(marked, keys).drop("_deletes")


def listed_columns(lists: Iterable[str], key: str) -> list[str]:
    """The columns of several configured lists, in order, each once in whatever case."""
    out: dict[str, str] = {}
    for cols in lists:
        for name in column_names(cols):
            if name and name.lower() != key.lower():
                out.setdefault(name.lower(), name)
    return list(out.values())


def stored_changes(latest: DataFrame, table: str, key: str, columns: Sequence[str]) -> DataFrame:
    """The changes of one dimension as stored rows.

    A change carries the columns that its own source table lists; the others are NULL.
    A listed column that the row lacks is ``''``.
    """
    cleaners = CLEANERS.get(table, {})
    own = F.transform(F.split("cols", ","), lambda c: F.lower(F.trim(c)))
    upsert = F.col("type") != DELETE_TYPE

    def column(name: str) -> Column:
        raw = F.try_element_at("data", F.lit(name))
        cleaned = cleaners[name](raw) if name in cleaners else raw
        listed = F.array_contains(own, name.lower())
        return F.when(upsert & listed, F.coalesce(cleaned, F.lit(""))).alias(name)

    seq = F.col("seq")
    rows = latest.filter(F.col("phoenix_table_name") == table)
    older = T.MapType(T.StringType(), latest.schema["seq"].dataType)
    return rows.select(
        F.col("pk").alias(key), *[column(c) for c in columns],
        F.when(upsert, seq).alias(SEQ), F.when(~upsert, seq).alias(DELETED), F.lit(None).cast(older).alias(OLDER),
    )


def merge_stored(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One stored row per key, in whatever order its changes came.

    Every column keeps the value of the greatest position that carried it, if that is
    after the last deletion.  Deleted keys stay, so that an older change that comes
    later does not bring a row back.
    """
    gathered = rows.groupBy(key).agg(
        F.max(SEQ).alias(SEQ), F.max(DELETED).alias(DELETED),
        *[
            F.max(
                F.when(
                    F.col(c).isNotNull(),
                    F.struct(F.coalesce(F.try_element_at(OLDER, F.lit(c)), F.col(SEQ)).alias("at"), F.col(c).alias("value")),
                )
            ).alias(c)
            for c in columns
        ],
    )

    def live(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(DELETED).isNull() | (F.col(c)["at"] > F.col(DELETED)))

    positions = [
        F.when(live(c) & (F.col(c)["at"] != F.col(SEQ)), F.struct(F.lit(c).alias("key"), F.col(c)["at"].alias("value")))
        for c in columns
    ]
    older = F.map_from_entries(F.array_compact(F.array(*positions))) if columns else F.lit(None)
    kept = F.when(F.size(older) > 0, older) if columns else older.cast(rows.schema[OLDER].dataType)
    return gathered.select(
        key, *[F.when(live(c), F.col(c)["value"]).alias(c) for c in columns], SEQ, DELETED, kept.alias(OLDER)
    )


def present_rows(stored: DataFrame) -> DataFrame:
    """The rows that are there: upserted, and not deleted since."""
    there = F.col(SEQ).isNotNull() & (F.col(DELETED).isNull() | (F.col(SEQ) > F.col(DELETED)))
    return stored.filter(there).drop(SEQ, DELETED, OLDER)
