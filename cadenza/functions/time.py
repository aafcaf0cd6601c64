"""Event time in its four encodings, and window bounds as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.fixed_values import DATE_FORMAT, HOUR_FORMAT, TIME_FORMAT


#: Milliseconds of the years 1 to 9999, which times are kept to.
FIRST_MILLIS = -62_135_596_800_000
LAST_MILLIS = 253_402_300_799_999


def usable_millis(c: Column) -> Column:
    """Epoch milliseconds that are a time; NULL otherwise, so that none fails a job."""
    return F.when(c.between(FIRST_MILLIS, LAST_MILLIS), c)


def seconds_to_millis(c: Column) -> Column:
    """Epoch seconds (text or number) to epoch milliseconds; NULL where unusable."""
    return usable_millis(F.try_multiply(c.try_cast("bigint"), F.lit(1000).cast("bigint")))


def millis_to_timestamp(c: Column) -> Column:
    return F.timestamp_millis(usable_millis(c))


def local_text_to_timestamp(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in the session zone; NULL where malformed."""
    return F.try_to_timestamp(c, F.lit(TIME_FORMAT))


def timestamp_to_text(c: Column) -> Column:
    return F.date_format(c, TIME_FORMAT)


def date_of_millis(c: Column) -> Column:
    return F.date_format(millis_to_timestamp(c), DATE_FORMAT)


def hour_of_millis(c: Column) -> Column:
    return F.date_format(millis_to_timestamp(c), HOUR_FORMAT)


def kept_above_watermark(predicate: Column, event_time: Column | str) -> Column:
    """A filter condition the optimizer cannot move below ``withWatermark``.

    A plain predicate is pushed under the watermark node, and rows it removes
    then no longer advance event time.  Tying it to the event-time column keeps
    it above, so that filtered rows still close windows.
    """
    ts = F.col(event_time) if isinstance(event_time, str) else event_time
    return F.when(predicate, ts).isNotNull()
