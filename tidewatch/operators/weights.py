"""Decayed weights of clusters over time, from their assignments.

Decay multiplies every weight by the same factor and each post adds one, so the weight of a
cluster at time ``t`` is the sum of ``2^(-(t - t_i) / half_life)`` over its posts so far. Posts are
first summed into cells of the calendar grid (combined before the shuffle, so a cluster holding a
third of all posts costs no more than any other); only the cells reach a window.

``assignments`` has the key columns (``cluster_id`` by default) and ``timestamp``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import times
from tidewatch.runtime import by_key
from tidewatch.schema import TrendParams

# Sums are kept relative to the start of an epoch of this many half-lives: 2^400 times any row
# count stays far below the largest double.
EPOCH_HALF_LIVES = 400

# Cells per snapshot interval where every post gets its own weight.
POST_CELLS = 60


def last_grid_number(df: DataFrame, p: TrendParams, ts: str = "timestamp") -> int | None:
    """Grid point at or after the newest time in ``df``; None when it is empty."""
    newest = df.agg(F.max(times.grid_number(F.col(ts), p.interval_micros)).alias("g")).first()
    return newest["g"]


def _pow2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def weight_cells(assignments: DataFrame, p: TrendParams, keys: list[str], since: int | None = None) -> DataFrame:
    """Mass and count of each occupied cell: ``keys, g, mass, n``.

    ``mass`` is the weight the cell's posts have at the cell's end. With ``since``, everything up
    to that grid point is summed into one cell there, which leaves all later weights unchanged.
    """
    g = times.grid_number(F.col("timestamp"), p.interval_micros)
    if since is not None:
        g = F.greatest(g, F.lit(since))
    age = F.col("_g") * F.lit(p.interval_micros) - times.micros(F.col("timestamp"))
    return (
        assignments.select(*keys, "timestamp", g.alias("_g"))
        .select(*keys, F.col("_g").alias("g"), _pow2(-age / F.lit(p.half_life_micros)).alias("m"))
        .groupBy(*keys, "g")
        .agg(F.sum("m").alias("mass"), F.count("*").alias("n"))
    )


def cell_weights(cells: DataFrame, p: TrendParams, keys: list[str]) -> DataFrame:
    """Adds ``weight``, the decayed weight at the end of each occupied cell.

    Weights older than two epochs have lost over 400 halvings and are below any double sum here.
    """
    steps = max(1, math.floor(EPOCH_HALF_LIVES * p.steps_per_half_life))
    rate = 1.0 / p.steps_per_half_life
    within = W.partitionBy(*keys, "_epoch").orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_epoch").rangeBetween(-1, -1)
    return (
        by_key(cells, *keys)
        .withColumn("_epoch", times.floor_div(F.col("g"), steps))
        .withColumn("_k", (F.col("g") - F.col("_epoch") * steps) * F.lit(rate))
        .withColumn("_scaled", F.col("mass") * _pow2(F.col("_k")))
        .withColumn("_here", F.sum("_scaled").over(within))
        .withColumn("_carry", F.coalesce(F.sum("_scaled").over(before), F.lit(0.0)) * F.lit(2.0 ** (-steps * rate)))
        .withColumn("weight", (F.col("_here") + F.col("_carry")) * _pow2(-F.col("_k")))
        .drop("_epoch", "_k", "_scaled", "_here", "_carry")
    )


def weight_history(
    assignments: DataFrame,
    p: TrendParams,
    keys: list[str] | None = None,
    last: int | None = None,
    since: int | None = None,
) -> DataFrame:
    """Weight of every live cluster at every grid point: ``keys, g, grid_ts, weight, life``.

    Occupied cells are carried forward to the next occupied one, for as long as the weight stays
    at or above ``min_cluster_weight``; dead stretches take no rows. ``life`` numbers the stretches
    of a key, since a key that died and returns starts a new history.
    """
    keys = keys or ["cluster_id"]
    if last is None:
        last = last_grid_number(assignments, p)
    rate = 1.0 / p.steps_per_half_life
    by_key = W.partitionBy(*keys).orderBy("g")
    weights = cell_weights(weight_cells(assignments, p, keys, since), p, keys)
    alive_steps = F.floor(F.log2(F.greatest(F.col("weight"), F.lit(1e-300)) / p.min_cluster_weight) / rate) + 1
    until = F.least(
        F.coalesce(F.lead("g").over(by_key) - 1, F.lit(last).cast("bigint")),
        F.lit(last).cast("bigint"),
        F.col("g") + alive_steps,
    )
    live = (
        weights.withColumn("_until", until)
        .filter(F.col("_until") >= F.col("g"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_until") - F.col("g"))))
        .withColumn("weight", F.col("weight") * _pow2(-F.col("_j") * F.lit(rate)))
        .filter(F.col("weight") >= p.min_cluster_weight)
        .withColumn("g", F.col("g") + F.col("_j"))
    )
    starts = F.when(F.col("g") - F.lag("g").over(by_key) == 1, F.lit(0)).otherwise(F.lit(1))
    running = W.partitionBy(*keys).orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    return (
        live.withColumn("_start", starts)
        .withColumn("life", F.sum("_start").over(running).cast("bigint"))
        .select(*keys, "g", times.grid_time(F.col("g"), p.interval_micros).alias("grid_ts"), "weight", "life")
    )


def post_weights(assignments: DataFrame, p: TrendParams, keys: list[str] | None = None) -> DataFrame:
    """Adds to each post the weight of its cluster just after the post.

    Two levels: the weight at the start of the post's cell comes from the cell table, the rest from a
    window inside the cell, so no window ever spans all posts of one cluster. The cells are a small
    part of the snapshot interval, to keep the windows of a crowded cluster short.
    Posts of one instant are taken in ``post_id`` order.
    """
    keys = keys or ["cluster_id"]
    p = p.with_(snapshot_interval_seconds=p.interval_seconds / POST_CELLS)
    rate = 1.0 / p.steps_per_half_life
    posts = assignments.withColumn("g", times.grid_number(F.col("timestamp"), p.interval_micros))
    cells = cell_weights(weight_cells(assignments, p, keys), p, keys)
    gap = F.col("g") - F.lag("g").over(W.partitionBy(*keys).orderBy("g"))
    carried = F.lag("weight").over(W.partitionBy(*keys).orderBy("g")) * _pow2(-(gap - 1) * F.lit(rate))
    carry = cells.select(*keys, "g", F.coalesce(carried, F.lit(0.0)).alias("_carry"))
    start = (F.col("g") - 1) * F.lit(p.interval_micros)
    age = (times.micros(F.col("timestamp")) - start) / F.lit(p.half_life_micros)
    within = W.partitionBy(*keys, "g").orderBy("timestamp", "post_id").rowsBetween(W.unboundedPreceding, 0)
    return (
        posts.join(carry, [*keys, "g"])
        .withColumn("_age", age)
        .withColumn("weight", (F.col("_carry") + F.sum(_pow2(F.col("_age"))).over(within)) * _pow2(-F.col("_age")))
        .drop("g", "_carry", "_age")
    )
