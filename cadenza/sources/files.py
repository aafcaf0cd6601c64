"""Questions to the file system the session writes to, and batch-wise writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True iff a write to this folder was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder in one step."""
    where, fs = _path(spark, source)
    if not fs.rename(where, _path(spark, target)[0]):
        raise OSError(f"cannot move {source} to {target}")


def write_whole(writer: Callable[[str], None], spark: SparkSession, path: str, name: str) -> None:
    """Let ``writer`` fill the folder ``path/name``, which readers see whole or not at all.

    It is written beside, below a hidden name that no reader lists, and moved
    when its write is committed.  A folder that is there already is left as it is;
    what an aborted attempt left behind is overwritten.
    """
    target = f"{path}/{name}"
    if exists(spark, target):
        return
    staged = f"{path}/.staged-{name}"
    writer(staged)
    move(spark, staged, target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def current_run(spark: SparkSession) -> str | None:
    """Id of the stream whose micro-batch is being written, kept in its checkpoint.

    A stream that starts with a new checkpoint has a new id and counts its batches
    from 0 again; None outside of streams.
    """
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def batch_name(spark: SparkSession, batch_id: int) -> str:
    """Folder of a micro-batch: a batch of the same number of another stream is no replay."""
    run = current_run(spark)
    return f"batch_id={batch_id}" if run is None else f"batch_id={batch_id}-{run}"


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Write one micro-batch below ``path``, once however often it is replayed."""
    spark = df.sparkSession
    write_whole(
        lambda target: df.write.mode("overwrite").format(fmt).save(target), spark, path, batch_name(spark, batch_id)
    )


def publish(spark: SparkSession, path: str, name: str, text: str) -> bool:
    """Put a small text file in place in one rename; False if the name is taken."""
    target = f"{path}/{name}"
    if exists(spark, target):
        return False
    staged, fs = _path(spark, f"{path}/.staged-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.rename(staged, _path(spark, target)[0]):
        return True
    fs.delete(staged, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _path(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of all that lies directly below ``path``, without hidden files."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return []
    return sorted(n for s in fs.listStatus(where) if not (n := s.getPath().getName()).startswith("."))


def data_files(spark: SparkSession, path: str) -> list[str]:
    """All files below a folder as a scan names them, without hidden ones."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return []
    found, walk = [], fs.listFiles(where, True)
    while walk.hasNext():
        file = walk.next().getPath()
        own = file.toString()[len(fs.makeQualified(where).toString()):]
        if not any(p.startswith((".", "_")) and "=" not in p for p in own.split("/")):
            found.append(file.toUri().toString())
    return sorted(found)
