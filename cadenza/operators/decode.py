"""Base64-wrapped JSON batches of events: decode, explode, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.once import evaluated_once


def _elements(value: Column) -> Column:
    text = F.try_to_binary(value, F.lit("base64")).cast("string")
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def decode_events(messages: DataFrame, value: str = "value", out: str = "event") -> DataFrame:
    """One row per event of each message; other columns are repeated.

    A message that is no Base64, or no JSON array, yields no row: see
    :func:`undecodable_messages`.
    """
    keep = [c for c in messages.columns if c != value]
    exploded = messages.select(*keep, F.explode(_elements(F.col(value))).alias(out))
    return exploded.filter(F.col(out).isNotNull())


def undecodable_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """The messages :func:`decode_events` drops, with a reason."""
    return messages.filter(_elements(F.col(value)).isNull()).withColumn(
        "reason", F.lit("not a base64 JSON array")
    )


def encode_events(batches: DataFrame, events: str = "events", out: str = "value") -> DataFrame:
    """Inverse of :func:`decode_events` for an array of structs per row."""
    keep = [c for c in batches.columns if c != events]
    return batches.select(*keep, F.base64(F.encode(F.to_json(events), "UTF-8")).alias(out))


def to_json_value(df: DataFrame) -> DataFrame:
    """Whole row as one JSON text column ``value`` (absent fields are left out)."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def parse_records(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON text as typed columns; a narrow ``schema`` reads only those fields.

    Text that is no JSON object gives a row of NULLs, which the next validity
    filter removes.
    """
    parsed = evaluated_once(messages, {"r": F.from_json(F.col(value), schema)})
    return parsed.select("r.*")
