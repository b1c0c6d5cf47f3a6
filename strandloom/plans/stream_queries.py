"""Registered streaming query: the event table read as a stream and run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.runtime import shared_dir, table
from strandloom.streaming.metrics import windowed_metrics


def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Daily metrics of every tool; the watermark is wide enough to keep all rows of the table."""
    at = f"{shared_dir(spark)}/strandloom/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    query = (
        windowed_metrics(source, "1 day", "3650 days")
        .writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out"))
        .option("checkpointLocation", f"{at}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("mean", F.round("mean", 6)).withColumn("slowest", F.round("slowest", 6))


QUERIES = {"stream_metrics": stream_metrics}
ORACLE = {
    "stream_metrics": """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, count(*) FILTER (value < 0) AS errors,
round(avg(value), 6) AS mean, round(max(value), 6) AS slowest FROM events WHERE ts IS NOT NULL GROUP BY ALL"""
}
