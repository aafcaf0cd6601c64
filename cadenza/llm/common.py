"""Shared helpers: words, safe column names, written intermediate tables."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import run_dir
from cadenza.sources import files

#: A word is a longest run without blanks, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Bytes of the rows that go to Python together: long texts come by few, short rows as before.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that tasks send to Python by bytes, where the session sets no bound of its own.

    Spark reads the setting where a result is computed, so it is left set.
    """
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, with a null text read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not use yet, in whatever letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Writer's options for rows of megabytes: sizes are looked at after each row, not after a hundred, as
#: a page is compressed, and a row group read, as one piece of memory.
LARGE_ROWS = {
    "parquet.block.size": str(16 << 20),
    **{f"parquet.{part}.size.row.check.{end}": "1" for part in ("page", "block") for end in ("min", "max")},
}


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``options`` are the writer's.

    Cuts the lineage, so that a lost executor costs no more than the steps since,
    and keeps a table that is read several times from being computed each time.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = run_dir(spark, name)
    df.write.options(**(options or {})).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


#: where the tables of :func:`materialize` lie, as long as anyone holds them
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` once no later step reads them.

    What was made of them must be written already.
    """
    for table in tables:
        path = _WRITTEN.pop(table, None)
        if path is not None:
            files.delete(table.sparkSession, path)
