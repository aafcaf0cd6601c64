"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings the operators are planned for.  Shuffles start wide and adaptive
#: execution coalesces them to the advisory size, so one value serves small and
#: very large inputs; skewed join partitions are split at run time.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3.0",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(
    app_name: str = "cadenza",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Create a session with :data:`DEFAULT_CONF`.

    ``shuffle_partitions`` should be about (largest shuffled bytes / 128 MB) on a
    cluster; adaptive execution merges the ones that turn out small.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_LOCAL_ROOTS: dict[str, str] = {}


def configured_dir(spark: SparkSession) -> str | None:
    """The folder the cluster names in ``spark.checkpoint.dir``, if it does."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path below the cluster's shared folder.

    Only where the session names none and runs on one machine (as in tests) a
    temporary folder is made, one per application.
    """
    root = configured_dir(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="cadenza-")
        root = _LOCAL_ROOTS[app]
    return "/".join([root.rstrip("/"), *parts])


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, below :func:`shared_dir`."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
