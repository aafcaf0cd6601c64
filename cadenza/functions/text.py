"""Text clean-up as column expressions (all inside whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.fixed_values import EMPTY_LIST_TEXT, NO_INFO

# every character up to U+0020, which is more than the blanks SQL trim removes
_EDGE_BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Trim blanks and control characters (all up to U+0020) on both sides."""
    return F.regexp_replace(_col(c), _EDGE_BLANKS, "")


def has_text(c: Column | str) -> Column:
    """True iff the text is there and not blank; never NULL."""
    return F.coalesce(trim_all(c) != "", F.lit(False))


def strip_whitespace(c: Column | str) -> Column:
    """Delete all whitespace, also inside the text."""
    return F.regexp_replace(_col(c), r"\s+", "")


def clean_value(c: Column | str, placeholder: str = NO_INFO) -> Column:
    """Trimmed text, or the placeholder where it is missing or blank."""
    return F.coalesce(F.nullif(trim_all(c), F.lit("")), F.lit(placeholder))


def clean_album(c: Column | str) -> Column:
    return clean_value(c)


def clean_company(c: Column | str) -> Column:
    return clean_value(c)


def singer_name(c: Column | str) -> Column:
    """Singer name out of plain text or of a JSON list of objects with a name.

    A list that cannot be parsed, or whose objects carry no name, stays as text.
    """
    text = trim_all(c)
    listed = F.get(F.filter(F.from_json(text, "array<struct<name:string>>").getField("name"),
                            lambda n: n.isNotNull()), F.lit(0))
    return F.when(text.startswith("[") & listed.isNotNull(), listed).otherwise(clean_value(c))


def region_province(raw: Column | str) -> Column:
    """Province with all whitespace removed."""
    return strip_whitespace(raw)


def region_city(city: Column | str, raw_province: Column | str) -> Column:
    """City, or the province as received where the city is blank or an empty list."""
    city = _col(city)
    blank = ~F.coalesce(F.regexp_replace(city, r"\s+", "") != "", F.lit(False))
    return F.when(blank | (city == EMPTY_LIST_TEXT), _col(raw_province)).otherwise(city)


def location_key(lng: Column | str, lat: Column | str) -> Column:
    """``lng,lat`` as the geocoder wants it."""
    return F.concat(_col(lng), F.lit(","), _col(lat))


def batch_location_key(keys: Column | str) -> Column:
    """``lng1,lat1|lng2,lat2|...`` for an array of location keys."""
    return F.array_join(_col(keys), "|")
