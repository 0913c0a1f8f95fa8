"""An extension beyond the batch tables: event streams in windows, late events within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream; new files are read as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, events, amount) per window and kind; the amount is an exact decimal."""
    amount = F.col("value").cast("decimal(18,2)")
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(amount).alias("amount"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "events", F.col("amount").cast("double").alias("amount"))


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived as Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows over the whole table as a batch."""
    return windowed(spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES = {"event_windows": windowed_batch}
ORACLES = {"event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS amount FROM events GROUP BY 1, 2"}
