"""The daily rollup over a stream of trips: the batch algebra with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, *, time: str = "ts", value: str = "value", by: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of a streaming (or batch) frame by window and label; rows later than the watermark are left out."""
    source = events.withColumn(time, F.col(time).cast("timestamp"))
    source = source.withWatermark(time, late) if source.isStreaming else source
    sums = source.groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("start"), by, "n", "total")
