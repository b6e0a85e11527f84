"""Growth, burst score and state of clusters, from their weight history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import scoring, times
from tidewatch.operators.quantiles import exact_quantile
from tidewatch.operators.weights import last_grid_number, weight_history
from tidewatch.schema import STATE_ORDER, TrendParams

CALIBRATION_QUANTILE = 0.95
CALIBRATION_MIN_CLUSTERS = 5


def trend_features(history: DataFrame, p: TrendParams, keys: list[str] | None = None) -> DataFrame:
    """Adds ``velocity, growth_rate, burst_z`` over the last ``window_size`` snapshots of each row."""
    keys = keys or ["cluster_id"]
    ordered = W.partitionBy(*keys, "life").orderBy("g")
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    recent = ordered.rowsBetween(-(p.window_size - 1), 0)
    # snapshots of a life are consecutive grid points, so the oldest one in the window is a fixed
    # number of rows back, or the first of the life
    steps = F.least(F.col("g") - F.first("g").over(so_far), F.lit(p.window_size))
    back = F.least(F.col("_n"), F.lit(p.window_size - 1))
    oldest = F.coalesce(F.lag("weight", p.window_size - 1).over(ordered), F.first("weight").over(so_far))
    gain = F.col("weight") - F.col("_first")
    before = F.lag("weight").over(ordered)
    step = (F.col("weight") - before) / F.greatest(before, F.lit(scoring.EPS))
    sd = F.col("_sd")
    return (
        history.withColumns({"_first": oldest, "_n": steps, "_step": step})
        .withColumn("_elapsed", back * F.lit(p.interval_micros / 1_000_000.0))
        .withColumn("_mean", F.avg("_step").over(recent))
        .withColumn("_sd", F.stddev_samp("_step").over(recent))
        .withColumn("velocity", F.when(F.col("_elapsed") > 0, gain / F.col("_elapsed")).otherwise(0.0))
        .withColumn(
            "growth_rate",
            F.when(
                F.col("_elapsed") > 0,
                gain / F.greatest(F.col("_first"), F.lit(scoring.EPS)) * (F.lit(p.half_life_seconds) / F.col("_elapsed")),
            ).otherwise(0.0),
        )
        .withColumn(
            "burst_z",
            F.when((F.col("_n") >= 3) & (sd >= scoring.EPS), (F.col("_step") - F.col("_mean")) / sd).otherwise(0.0),
        )
        .drop("_first", "_elapsed", "_step", "_mean", "_sd", "_n")
    )


def trend_states(features: DataFrame, p: TrendParams, cutoff: float | None = None) -> DataFrame:
    limit = F.lit(cutoff) if cutoff is not None else None
    return features.withColumn(
        "state", scoring.state_of(F.col("growth_rate"), F.col("weight"), F.col("burst_z"), p, limit)
    )


def calibrated_cutoff(features: DataFrame, p: TrendParams) -> float:
    """95th percentile of the growth of clusters with enough weight, never below the default."""
    eligible = features.filter(F.col("weight") >= p.min_weight)
    value, n = exact_quantile(eligible, "growth_rate", CALIBRATION_QUANTILE)
    if n < CALIBRATION_MIN_CLUSTERS:
        return p.trending_growth
    return max(p.trending_growth, value)


def trend_summary(
    assignments: DataFrame,
    p: TrendParams,
    keys: list[str] | None = None,
    auto_calibrate: bool = False,
    last: int | None = None,
) -> DataFrame:
    """Weight, velocity, growth, burst score and state of each live cluster at the last grid point.

    Only the last ``window_size + 1`` grid points enter the windows; all earlier posts arrive as one
    carried-over sum per cluster.
    """
    keys = keys or ["cluster_id"]
    if last is None:
        last = last_grid_number(assignments, p)
    last = last if last is not None else 0
    history = weight_history(assignments, p, keys, last=last, since=last - p.window_size)
    latest = trend_features(history, p, keys).filter(F.col("g") == last)
    cutoff = calibrated_cutoff(latest, p) if auto_calibrate else None
    return trend_states(latest, p, cutoff).select(*keys, "weight", "velocity", "growth_rate", "burst_z", "state")


def state_transitions(history: DataFrame, p: TrendParams, keys: list[str] | None = None) -> DataFrame:
    """A row whenever the state of a cluster differs from its previous one, the first state included."""
    keys = keys or ["cluster_id"]
    previous = F.lag("state").over(W.partitionBy(*keys, "life").orderBy("g"))
    return (
        trend_states(trend_features(history, p, keys), p)
        .withColumn("_previous", previous)
        .filter(~F.col("state").eqNullSafe(F.col("_previous")))
        .select(F.col("grid_ts").alias("timestamp"), *keys, "state")
    )


def state_mix(summary: DataFrame) -> DataFrame:
    """Clusters per state, all four states present."""
    spark = summary.sparkSession
    states = spark.createDataFrame([(i, s) for i, s in enumerate(STATE_ORDER)], "state_rank int, state string")
    counts = summary.groupBy("state").agg(F.count("*").alias("n"))
    return (
        F.broadcast(states)
        .join(counts, "state", "left")
        .select("state_rank", "state", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_clusters"))
    )


def top_clusters(summary: DataFrame, k: int, by: str = "weight", tie: str = "cluster_id") -> DataFrame:
    return summary.orderBy(F.desc(by), F.asc(tie)).limit(k)


def board_order(summary: DataFrame) -> DataFrame:
    """Trending first, fastest growth first."""
    ranked = summary.withColumn("state_rank", scoring.state_rank(F.col("state")))
    return ranked.orderBy("state_rank", F.desc("growth_rate"), "cluster_id")


def grid_iso(df: DataFrame, col: str = "grid_ts") -> DataFrame:
    return df.withColumn(col, times.iso(F.col(col)))
