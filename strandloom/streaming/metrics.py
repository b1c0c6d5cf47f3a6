"""Service metrics as a stream (an extension: the batch form is ``records.service_metrics``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, errors, mean, slowest) per tumbling window of ``ts``.

    Rows later than ``late`` are dropped by the watermark, as streams must bound their state;
    rows with a null ``ts`` belong to no window. Works on batch frames too.
    """
    return (
        events.where("ts is not null")
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("value") < 0).alias("errors"),
            F.avg("value").alias("mean"),
            F.max("value").alias("slowest"),
        )
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "errors", "mean", "slowest")
    )
