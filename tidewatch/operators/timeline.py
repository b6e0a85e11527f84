"""Platform time windows, their overlap, and alignment onto one window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import times
from tidewatch.runtime import broadcast_if_small


def platform_windows(posts: DataFrame) -> DataFrame:
    """First and last valid time and their count per platform."""
    return posts.groupBy("platform").agg(
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        F.count("timestamp").alias("n_posts"),
    )


def restrict_to_overlap(posts: DataFrame) -> DataFrame:
    """Posts inside the window all platforms share; empty when there is none.

    The two bounds are read first, so the filter reaches the file scan.
    """
    windows = platform_windows(posts)
    bounds = windows.agg(F.max("min_timestamp").alias("a"), F.min("max_timestamp").alias("b"))
    row = bounds.select(times.micros(F.col("a")).alias("a"), times.micros(F.col("b")).alias("b")).first()
    if row["a"] is None or row["b"] is None or row["a"] > row["b"]:
        return posts.filter(F.lit(False))
    start, end = F.timestamp_micros(F.lit(row["a"])), F.timestamp_micros(F.lit(row["b"]))
    return posts.filter((F.col("timestamp") >= start) & (F.col("timestamp") <= end))


def align_timelines(posts: DataFrame, target_days: float = 30.0) -> DataFrame:
    """Stretches each platform's span onto the same window from the earliest post on.

    The real time stays in ``timestamp_original``; every row is marked ``aligned``.
    """
    spans = broadcast_if_small(
        platform_windows(posts).select(
            "platform",
            times.micros(F.col("min_timestamp")).alias("_lo"),
            times.micros(F.col("max_timestamp")).alias("_hi"),
        )
    )
    anchor = spans.agg(F.min("_lo").alias("a")).first()["a"]
    target = F.lit(target_days * 86_400_000_000.0)
    span = (F.col("_hi") - F.col("_lo")).cast("double")
    scale = F.when(span > 0, target / F.when(span > 0, span)).otherwise(F.lit(1.0))
    moved = F.lit(anchor) + F.round((times.micros(F.col("timestamp")) - F.col("_lo")) * scale).cast("bigint")
    return (
        posts.join(spans, "platform")
        .withColumn("timestamp_original", F.col("timestamp"))
        .withColumn("timestamp", F.timestamp_micros(moved))
        .withColumn("timeline_mode", F.lit("aligned"))
        .drop("_lo", "_hi")
    )


def platform_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("platform").agg(F.count("*").alias("n_posts"))


def daily_counts(posts: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """Posts per day, one zero-filled column per platform."""
    days = posts.withColumn("day", F.date_trunc("day", F.col("timestamp")))
    counted = days.groupBy("day", "platform").agg(F.count("*").alias("n"))
    return counted.groupBy("day").pivot("platform", platforms).agg(F.sum("n")).na.fill(0)
