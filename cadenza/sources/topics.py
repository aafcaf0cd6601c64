"""Topics of text messages: Kafka, or folders of lines with the same interface.

Both give ``value`` (text) and ``seq`` (an orderable position), read as a stream
or as a table, and write ``value`` (and ``topic``).  The Kafka connector is a
separate package of Spark and must be on the class path to use
:class:`KafkaTopics`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.files import batch_name, data_files, exists, publish, write_batch, write_whole


def starting_offsets(mode: str | None) -> str:
    """``latest`` in any spelling; everything else starts at the beginning."""
    return "latest" if (mode or "").lower() == "latest" else "earliest"


def _same_path(file: Column) -> Column:
    """A path with one slash after its scheme, however many it was written with."""
    return F.regexp_replace(file, "^([A-Za-z0-9]+:)/+", "$1/")


#: folder of the messages that name their topic
ROUTED = "_by_topic"


@dataclass(frozen=True)
class KafkaTopics:
    """Topics of a Kafka cluster; writes are at-least-once."""

    servers: str
    options: dict[str, str] = field(default_factory=dict)

    def read(
        self, spark: SparkSession, topic: str, starting: str = "latest", stream: bool = True
    ) -> DataFrame:
        reader = spark.readStream if stream else spark.read
        start = starting_offsets(starting) if stream else "earliest"
        raw = (
            reader.format("kafka")
            .option("kafka.bootstrap.servers", self.servers)
            .option("subscribe", topic)
            .option("startingOffsets", start)
            .options(**self.options)
            .load()
        )
        return raw.select(
            F.col("value").cast("string").alias("value"),
            # a key keeps to its partition, whose offsets are the order of arrival;
            # producers' timestamps may run backwards
            F.struct("partition", "offset").alias("seq"),
        )

    def ordered(self, batch: DataFrame) -> DataFrame:
        """A table or micro-batch whose ``seq`` orders every message: it does already."""
        return batch

    def write_batch(self, rows: DataFrame, batch_id: int, topic: str | None = None) -> None:
        """Send ``value`` to ``topic``, or each row to the topic it names."""
        del batch_id
        writer = rows.write.format("kafka").option("kafka.bootstrap.servers", self.servers)
        (writer.option("topic", topic) if topic else writer).save()


@dataclass(frozen=True)
class FolderTopics:
    """Each topic is a folder of text files below ``root``; writes are exactly-once."""

    root: str
    max_files_per_trigger: int | None = None
    #: file that notes what was there at the first start
    mark: str | None = None

    def path(self, topic: str) -> str:
        return f"{self.root}/{topic}"

    def read(
        self, spark: SparkSession, topic: str, starting: str = "earliest", stream: bool = True
    ) -> DataFrame:
        """All messages; with a ``mark`` a stream may start at ``latest``.

        Then the files that are there when the stream starts for the first time are
        noted beside its checkpoint, and their messages are left out for good.
        """
        reader = spark.readStream if stream else spark.read
        if stream and self.max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.max_files_per_trigger)
        path = self.path(topic)
        lines = reader.schema("value string").option("recursiveFileLookup", "true").text(path)
        rows = self._positioned(lines)
        if not stream or self.mark is None or starting_offsets(starting) != "latest":
            return rows
        folder, name = self.mark.rsplit("/", 1)
        if not exists(spark, self.mark):
            publish(spark, folder, name, "".join(f"{f}\n" for f in data_files(spark, path)))
        old = spark.read.schema("file string").text(self.mark).select(_same_path(F.col("file")).alias("_old"))
        return rows.join(old, _same_path(F.col("seq.file")) == F.col("_old"), "left_anti")

    @staticmethod
    def _positioned(lines: DataFrame) -> DataFrame:
        return lines.select(
            "value",
            F.struct(
                F.col("_metadata.file_modification_time").alias("modified"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
            ).alias("seq"),
        )

    def ordered(self, batch: DataFrame) -> DataFrame:
        """Refine ``seq`` of a table or micro-batch to the line within its file."""
        line = F.monotonically_increasing_id().alias("line")
        return batch.withColumn("seq", F.struct("seq.*", line))

    def write_batch(self, rows: DataFrame, batch_id: int, topic: str | None = None) -> None:
        if topic:
            write_batch(rows.select("value"), self.path(topic), batch_id, "text")
            return
        # one folder per topic named by the rows, all written in one job
        named = rows.select("topic", "value").write.mode("overwrite").partitionBy("topic")
        spark = rows.sparkSession
        write_whole(named.text, spark, f"{self.root}/{ROUTED}", batch_name(spark, batch_id))

    def read_routed(self, spark: SparkSession, topic: str, stream: bool = False) -> DataFrame:
        """Messages of one topic out of those written by row topic."""
        reader = (spark.readStream if stream else spark.read).schema("value string")
        if stream and self.max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.max_files_per_trigger)
        return self._positioned(reader.text(f"{self.root}/{ROUTED}/batch_id=*/topic={topic}"))
