"""The watch as a stream: payload rows arrive, known keys are dropped by state, new ones go to a table once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unseen(stream: DataFrame, key: str = "key", time: str = "ts", delay: str = "30 days") -> DataFrame:
    """Each key's first row within the watermark; state is dropped after the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def watch_into(stream: DataFrame, known: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, key: str = "key") -> StreamingQuery:
    """Every batch's rows whose key is in no table so far go to the sink, once each; a batch that is run again finds its own rows known."""

    def batch(df: DataFrame, number: int) -> None:
        fresh = df.dropDuplicates([key]).join(known().select(key), key, "left_anti")
        sink(fresh, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_stream(decisions: DataFrame) -> DataFrame:
    """The running status of each key from an append-only stream of decisions (complete mode)."""
    return decisions.groupBy("key").agg(F.max_by("decision", "id").alias("decision"), F.max("id").alias("id"))


def event_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per type in tumbling windows, late ones up to the delay."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def replay(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
