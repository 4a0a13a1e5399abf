"""The event log as a stream. An extension: micro-batches of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def read(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """A stream of event files; path may be a pattern. Watermarks need times with a zone: UTC."""
    rows = spark.readStream.schema(SCHEMA).parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Counts and sums by kind in windows of one size."""
    g = events.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A user's sessions: events less than a gap apart."""
    g = events.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event_id once, as far back as the watermark reaches."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def run_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Write what there is now as Parquet, exactly once, and stop."""
    rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
