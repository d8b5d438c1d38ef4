"""Windows over event tables, alike on batches and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late an event may come before a stream drops it.
DELAY = "10 minutes"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a session in one process (tests) gets a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="stream-")).rstrip("/")


def stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files of a folder, a bounded number of files each time."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Count and sum of values by tumbling or sliding window and type."""
    grouped = events.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a user: runs of events with less than ``gap`` between them."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key within the delay; later ones are dropped and the state expires."""
    return events.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(list(keys))


def first_events(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key by ``ts`` and ``event_id`` in all that a stream has, however late it comes.

    A running minimum whose state is one event a key and does not expire. Every batch writes what has changed as Parquet
    into the shared folder (``spark.checkpoint.dir``), where the stream's checkpoint is as well, and Spark reads it back.
    """
    spark = events.sparkSession
    first = F.min_by("e", F.struct("e.ts", "e.event_id")).alias("e")
    changed = events.select(F.struct(*events.columns).alias("e")).groupBy(*[F.col(f"e.{k}").alias(k) for k in keys]).agg(first)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], changed.schema).write.parquet(f"{folder}/rows/batch=-1")

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={k}")

    query = changed.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(changed.schema).parquet(f"{folder}/rows").groupBy(*keys).agg(first).select("e.*")
