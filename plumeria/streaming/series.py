"""Stance counts of a stream by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import stance_counts
from ..schemas import STANCES


def stance_windows(stream: DataFrame, date: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Stance counts by window; rows later than ``late`` are dropped, and a window's state with them."""
    stance = F.coalesce("stance", F.lit(STANCES[2]))
    timed = stream.withColumn("_at", F.col(date).cast("timestamp")).filter("_at is not null").withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", window).alias("w")).agg(*stance_counts(stance))
    return counted.select(F.col("w.start").alias("start"), "for_count", "against_count", "neutral_count")
