"""Append-only ingest of feature files, and windowed counts of timed events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.gff import COLUMNS


def ingest_features(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """Takes all GFF files that have come into folder and appends them to a Parquet table partitioned by seq, each once."""
    x = spark.readStream.schema(COLUMNS).option("sep", "\t").option("comment", "#").option("nullValue", ".").option("quote", "").csv(folder)
    x = x.withColumn("start", F.col("start") - 1)
    return x.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy("seq").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str, late: str, by: str = "event_type", time: str = "ts") -> DataFrame:
    """Counts and sums by tumbling event-time window; rows later than the watermark are left out when events is a stream."""
    t = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
