"""SQL text for the trend queries, written from the definitions: weights as direct sums over posts."""

from __future__ import annotations

from tidewatch.queries.registry import iso_sql
from tidewatch.schema import TrendParams


def history_sql(source: str, p: TrendParams, prefix: str = "") -> str:
    """CTEs ``hist(cluster_id, g, weight, life)`` from ``source(cluster_id, ts)``."""
    step, half = p.interval_micros, p.half_life_micros
    return f"""{prefix}us AS (SELECT cluster_id, epoch_us(ts) AS us FROM {source}),
  {prefix}grid AS (SELECT cluster_id, unnest(generate_series(lo, (SELECT CAST(ceil(max(us) / {step}.0::DOUBLE) AS BIGINT) FROM {prefix}us))) AS g
    FROM (SELECT cluster_id, CAST(ceil(min(us) / {step}.0::DOUBLE) AS BIGINT) AS lo FROM {prefix}us GROUP BY cluster_id)),
  {prefix}hist0 AS (SELECT grid.cluster_id, g, sum(power(2.0, -(g * {step} - us) / {half}::DOUBLE)) AS weight
    FROM {prefix}grid AS grid JOIN {prefix}us AS us ON grid.cluster_id = us.cluster_id AND us <= g * {step} GROUP BY ALL),
  {prefix}hist1 AS (SELECT *, CASE WHEN g - lag(g) OVER (PARTITION BY cluster_id ORDER BY g) = 1 THEN 0 ELSE 1 END AS start
    FROM {prefix}hist0 WHERE weight >= {p.min_cluster_weight}),
  {prefix}hist AS (SELECT cluster_id, g, weight, CAST(sum(start) OVER (PARTITION BY cluster_id ORDER BY g) AS BIGINT) AS life
    FROM {prefix}hist1)"""


def features_sql(p: TrendParams, hist: str = "hist", cutoff: str | None = None) -> str:
    """CTEs up to ``feat`` with velocity, growth_rate, burst_z and state of every history row."""
    limit = cutoff or str(p.trending_growth)
    back = p.window_size - 1
    seconds = p.interval_micros / 1e6
    return f"""f1 AS (SELECT *, first_value(weight) OVER w AS w0, (g - first_value(g) OVER w) * {seconds}::DOUBLE AS elapsed,
      weight - lag(weight) OVER o AS dw, lag(weight) OVER o AS pw FROM {hist}
    WINDOW o AS (PARTITION BY cluster_id, life ORDER BY g),
           w AS (PARTITION BY cluster_id, life ORDER BY g ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)),
  f2 AS (SELECT *, dw / greatest(pw, 1e-9) AS step FROM f1),
  f3 AS (SELECT *, avg(step) OVER w AS mu, stddev_samp(step) OVER w AS sd, count(step) OVER w AS n FROM f2
    WINDOW w AS (PARTITION BY cluster_id, life ORDER BY g ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)),
  feat0 AS (SELECT cluster_id, g, life, weight, CASE WHEN elapsed > 0 THEN (weight - w0) / elapsed ELSE 0 END AS velocity,
      CASE WHEN elapsed > 0 THEN (weight - w0) / greatest(w0, 1e-9) * ({p.half_life_seconds} / elapsed) ELSE 0 END AS growth_rate,
      CASE WHEN n >= 3 AND sd >= 1e-9 THEN (step - mu) / sd ELSE 0 END AS burst_z FROM f3),
  feat AS (SELECT *, CASE WHEN (growth_rate >= {limit} OR burst_z >= {p.burst_z_threshold}) AND weight >= {p.min_weight}
      THEN 'trending' WHEN growth_rate > 1e-9 THEN 'rising' WHEN growth_rate < -1e-9 THEN 'declining' ELSE 'dormant' END AS state
    FROM feat0)"""


def latest_sql(feat: str = "feat") -> str:
    return f"latest AS (SELECT * FROM {feat} WHERE g = (SELECT max(g) FROM {feat}))"


def transitions_sql(p: TrendParams, feat: str = "feat") -> str:
    return f"""trans AS (SELECT cluster_id, g, make_timestamp(g * {p.interval_micros}) AS ts, state FROM (
      SELECT *, lag(state) OVER (PARTITION BY cluster_id, life ORDER BY g) AS prev FROM {feat})
    WHERE prev IS DISTINCT FROM state)"""


def grid_iso(p: TrendParams, g: str = "g") -> str:
    return iso_sql(f"make_timestamp({g} * {p.interval_micros})")
