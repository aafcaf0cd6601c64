"""JSON reading with the leniency of a typed getter.

Every scalar is first read as text (one parse per level, whatever the number of
fields) and then coerced; text that does not fit becomes NULL and never fails
the job, also under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_struct(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def parse_object(c: Column, names: Sequence[str]) -> Column:
    """Parse an object into text fields.

    A nested object arrives as its JSON text, and so does an object that was
    sent as a JSON *string*: both are parsed by another call on that field.
    """
    return F.from_json(c, text_struct(names))


MALFORMED = "_malformed"


def parse_checked_object(c: Column, names: Sequence[str]) -> Column:
    """:func:`parse_object` with one more field, not NULL iff the text is no JSON object."""
    return F.from_json(
        c, text_struct([*names, MALFORMED]), {"columnNameOfCorruptRecord": MALFORMED}
    )


def _absent_text(c: Column) -> Column:
    return c.isNull() | (c == "") | (F.lower(c) == "null")


def as_long(c: Column) -> Column:
    """Integer out of an integer, a decimal (truncated) or digits in a string."""
    wide = c.try_cast("decimal(38,10)").try_cast("bigint")
    return F.when(~_absent_text(c), F.coalesce(c.try_cast("bigint"), wide))


def as_int(c: Column) -> Column:
    return as_long(c).try_cast("int")


def as_boolean(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin("true", "1", "y", "t"), F.lit(True)).when(
        word.isin("false", "0", "n", "f"), F.lit(False)
    )


def is_bad_number(c: Column) -> Column:
    """True iff something is there but is no number; never NULL."""
    return ~_absent_text(c) & as_long(c).isNull()


def string_list(c: Column) -> Column:
    """JSON text of a list as an array; missing, blank or malformed gives ``[]``."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
