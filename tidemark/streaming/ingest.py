"""Continuous ingestion: file streams, daily windows with a watermark, and merges of every micro-batch.

A batch is committed under its number (see ledger): a batch that runs again after a failure finds its commit and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import ledger

#: How long a day may still be restated.
LOOKBACK = "7 days"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def timed(events: DataFrame, lateness: str = LOOKBACK) -> DataFrame:
    """Events with a watermark on ts; the stateful steps below share it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def daily_counts(events: DataFrame) -> DataFrame:
    """Events and value of a timed stream by day and type; a day is final once the watermark has passed it."""
    out = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(20,6)")).cast("decimal(20,6)").alias("value"))
    return out.select(F.to_date("w.start").alias("day"), "event_type", "events", "value")


def once_each(events: DataFrame, key: str = "event_id") -> DataFrame:
    """A timed stream without events whose key came before within the lateness."""
    return events.dropDuplicatesWithinWatermark([key])


def merge_stream(stream: DataFrame, table: ledger.Ledger, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Commits every micro-batch to the table, takes what is there, and stops. A batch writes only the days that it touches.

    Of several rows of a key within a batch the last written by order stays whole; without order, the greatest. Batch n is
    commit n + 1, so a batch that runs again after a failure finds its commit or writes it anew.
    """
    step = lambda batch, number: ledger.commit(table, batch, number + 1, order) and None
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
