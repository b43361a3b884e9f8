"""Route metrics over a stream of outcome events: the batch aggregation with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_outcomes(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, action, n, correct) of (ts, action, correct) events, batch or stream; rows later than `late` are left out of streams."""
    g = events.withWatermark("ts", late) if events.isStreaming else events
    w = g.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("correct"))
    return w.select(F.col("w.start").alias("start"), "action", "n", "correct")
