"""Evaluate costly expressions once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add ``columns`` so that later steps read values, not copies of expressions.

    Filters are pushed below a projection by copying its expressions, so a parsed
    column that feeds several branches would be parsed again in each filter and
    output column.  The output of a generator is not copied; a one-element
    ``inline`` costs a row copy.
    """
    keep = [c for c in df.columns if c not in columns]
    value = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(value)))
