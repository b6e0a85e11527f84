"""Decayed weights, growth, burst scores and states."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import times
from tidewatch.operators import trend, weights
from tidewatch.plans import board
from tidewatch.queries.registry import SQL_POSTS, SQL_USER_POSTS, posts, query, rounded, user_posts
from tidewatch.queries.sqltrend import features_sql, grid_iso, history_sql, latest_sql, transitions_sql
from tidewatch.schema import TrendParams

P = TrendParams()
HISTORY = f"WITH {SQL_USER_POSTS}, {history_sql('user_posts', P)}"
FEATURES = f"{HISTORY}, {features_sql(P)}"
LATEST = f"{FEATURES}, {latest_sql()}"
SUMMARY_COLUMNS = """cluster_id, round(weight, 6) AS weight, round(velocity, 9) AS velocity,
  round(growth_rate, 6) AS growth_rate, round(burst_z, 6) AS burst_z, state"""


def _summary(df):
    return rounded(rounded(df, "weight", "growth_rate", "burst_z"), "velocity", digits=9)


@query(
    "decayed_weight",
    f"""WITH {SQL_USER_POSTS}, u AS (SELECT *, epoch_us(ts) AS us FROM user_posts)
    SELECT a.post_id, a.cluster_id, round(sum(power(2.0, -(a.us - b.us) / {P.half_life_micros}::DOUBLE)), 6) AS weight
    FROM u a JOIN u b ON a.cluster_id = b.cluster_id AND b.us <= a.us GROUP BY ALL""",
)
def decayed_weight(spark, sf):
    return rounded(weights.post_weights(user_posts(spark, sf), P).select("post_id", "cluster_id", "weight"), "weight")


@query(
    "weight_history",
    f"{HISTORY} SELECT cluster_id, {grid_iso(P)} AS grid_ts, round(weight, 6) AS weight, life FROM hist",
)
def weight_history(spark, sf):
    hist = weights.weight_history(user_posts(spark, sf), P)
    return rounded(trend.grid_iso(hist).drop("g"), "weight")


@query(
    "bounded_history",
    f"""{HISTORY} SELECT cluster_id, {grid_iso(P)} AS grid_ts, round(weight, 6) AS weight FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY g DESC) AS rn FROM hist) WHERE rn <= 20""",
)
def bounded_history(spark, sf):
    hist = weights.weight_history(user_posts(spark, sf), P)
    newest = W.partitionBy("cluster_id").orderBy(F.desc("g"))
    kept = hist.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= P.window_size)
    return rounded(trend.grid_iso(kept).select("cluster_id", "grid_ts", "weight"), "weight")


@query(
    "growth_and_burst",
    f"""{FEATURES} SELECT cluster_id, {grid_iso(P)} AS grid_ts, round(weight, 6) AS weight, round(velocity, 9) AS velocity,
      round(growth_rate, 6) AS growth_rate, round(burst_z, 6) AS burst_z FROM feat""",
)
def growth_and_burst(spark, sf):
    hist = weights.weight_history(user_posts(spark, sf), P)
    feats = trend.grid_iso(trend.trend_features(hist, P)).drop("g", "life")
    return _summary(feats)


@query("trend_states", f"{LATEST} SELECT {SUMMARY_COLUMNS} FROM latest")
def trend_states(spark, sf):
    return _summary(trend.trend_summary(user_posts(spark, sf), P))


TYPE_PARAMS = P.with_(half_life_seconds=2 * 3600.0)
SQL_TYPE_POSTS = "type_posts AS (SELECT event_type AS cluster_id, ts FROM events)"


@query(
    "trend_by_event_type",
    f"""WITH {SQL_TYPE_POSTS}, {history_sql('type_posts', TYPE_PARAMS)}, {features_sql(TYPE_PARAMS)}
    SELECT cluster_id, {grid_iso(TYPE_PARAMS)} AS grid_ts, round(weight, 6) AS weight, round(growth_rate, 6) AS growth_rate,
      round(burst_z, 6) AS burst_z, state FROM feat""",
)
def trend_by_event_type(spark, sf):
    """Few hot keys: all posts fall on five clusters."""
    keyed = posts_by_type(spark, sf)
    feats = trend.trend_features(weights.weight_history(keyed, TYPE_PARAMS), TYPE_PARAMS)
    states = trend.grid_iso(trend.trend_states(feats, TYPE_PARAMS))
    return rounded(
        states.select("cluster_id", "grid_ts", "weight", "growth_rate", "burst_z", "state"), "weight", "growth_rate", "burst_z"
    )


def posts_by_type(spark, sf):
    from tidewatch.queries.registry import event_posts

    return event_posts(spark, sf).select("post_id", F.col("source").alias("cluster_id"), "timestamp")


@query(
    "state_transitions",
    f"{FEATURES}, {transitions_sql(P)} SELECT cluster_id, {grid_iso(P)} AS ts, state FROM trans",
)
def state_transitions(spark, sf):
    log = trend.state_transitions(weights.weight_history(user_posts(spark, sf), P), P)
    return log.select("cluster_id", times.iso(F.col("timestamp")).alias("ts"), "state")


@query(
    "state_mix",
    f"""{LATEST} SELECT i AS state_rank, s AS state, count(latest.cluster_id) AS n_clusters
    FROM (VALUES (0, 'trending'), (1, 'rising'), (2, 'declining'), (3, 'dormant')) AS v(i, s)
    LEFT JOIN latest ON latest.state = s GROUP BY ALL""",
)
def state_mix(spark, sf):
    return trend.state_mix(trend.trend_summary(user_posts(spark, sf), P))


CUTOFF = """cut AS (SELECT CASE WHEN count(*) >= 5 THEN greatest(0.25, quantile_cont(growth_rate, 0.95)) ELSE 0.25 END AS c,
  count(*) AS n FROM latest WHERE weight >= 0.5)"""


@query("calibrated_cutoff", f"{LATEST}, {CUTOFF} SELECT round(c, 6) AS cutoff FROM cut")
def calibrated_cutoff(spark, sf):
    cutoff = trend.calibrated_cutoff(trend.trend_summary(user_posts(spark, sf), P), P)
    summary = trend.trend_summary(user_posts(spark, sf), P)
    return summary.agg(F.max(F.round(F.lit(cutoff), 6)).alias("cutoff"))


@query(
    "calibrated_states",
    f"""{LATEST}, {CUTOFF} SELECT cluster_id, round(weight, 6) AS weight, round(growth_rate, 6) AS growth_rate,
      CASE WHEN (growth_rate >= c OR burst_z >= 2.5) AND weight >= 0.5 THEN 'trending' WHEN growth_rate > 1e-9 THEN 'rising'
      WHEN growth_rate < -1e-9 THEN 'declining' ELSE 'dormant' END AS state FROM latest, cut""",
)
def calibrated_states(spark, sf):
    summary = trend.trend_summary(user_posts(spark, sf), P, auto_calibrate=True)
    return rounded(summary.select("cluster_id", "weight", "growth_rate", "state"), "weight", "growth_rate")


MEMBERS = """members AS (SELECT cluster_id, count(*) AS member_count,
    string_agg(title, ' | ' ORDER BY rn DESC) FILTER (rn <= 5) AS sample_titles FROM (
      SELECT cluster_id, title, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, post_id DESC) AS rn FROM posts)
    GROUP BY cluster_id)"""


@query(
    "active_summary",
    f"""WITH {SQL_POSTS}, {SQL_USER_POSTS}, {history_sql('user_posts', P)}, {features_sql(P)}, {latest_sql()}, {MEMBERS}
    SELECT {SUMMARY_COLUMNS}, member_count, sample_titles FROM latest JOIN members USING (cluster_id)""",
)
def active_summary(spark, sf):
    return _summary(board.active_summary(posts(spark, sf), P))


@query(
    "top_by_weight",
    f"{LATEST} SELECT cluster_id, round(weight, 6) AS weight, state FROM latest ORDER BY latest.weight DESC, cluster_id LIMIT 15",
)
def top_by_weight(spark, sf):
    top = trend.top_clusters(trend.trend_summary(user_posts(spark, sf), P), 15)
    return rounded(top.select("cluster_id", "weight", "state"), "weight")


@query(
    "top_by_growth",
    f"{LATEST} SELECT cluster_id, round(growth_rate, 6) AS growth_rate FROM latest ORDER BY latest.growth_rate DESC, cluster_id LIMIT 10",
)
def top_by_growth(spark, sf):
    top = trend.top_clusters(trend.trend_summary(user_posts(spark, sf), P), 10, by="growth_rate")
    return rounded(top.select("cluster_id", "growth_rate"), "growth_rate")


@query(
    "top_histories",
    f"""{LATEST}, top AS (SELECT cluster_id FROM latest ORDER BY weight DESC, cluster_id LIMIT 6)
    SELECT cluster_id, {grid_iso(P)} AS grid_ts, round(weight, 6) AS weight FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY g DESC) AS rn FROM hist JOIN top USING (cluster_id)) WHERE rn <= 20""",
)
def top_histories(spark, sf):
    keyed = user_posts(spark, sf)
    top = trend.top_clusters(trend.trend_summary(keyed, P), 6).select("cluster_id")
    hist = weights.weight_history(keyed.join(F.broadcast(top), "cluster_id", "left_semi"), P, last=weights.last_grid_number(keyed, P))
    newest = W.partitionBy("cluster_id").orderBy(F.desc("g"))
    kept = hist.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= P.window_size)
    return rounded(trend.grid_iso(kept).select("cluster_id", "grid_ts", "weight"), "weight")


@query(
    "board_order",
    f"""{LATEST} SELECT cluster_id, state, CASE state WHEN 'trending' THEN 0 WHEN 'rising' THEN 1 WHEN 'declining' THEN 2
      WHEN 'dormant' THEN 3 ELSE 4 END AS state_rank, round(growth_rate, 6) AS growth_rate FROM latest
    ORDER BY 3, latest.growth_rate DESC, cluster_id""",
)
def board_order(spark, sf):
    ordered = trend.board_order(trend.trend_summary(user_posts(spark, sf), P))
    return rounded(ordered.select("cluster_id", "state", "state_rank", "growth_rate"), "growth_rate")


@query(
    "live_clusters",
    f"{LATEST} SELECT DISTINCT user_posts.cluster_id FROM user_posts SEMI JOIN latest USING (cluster_id)",
)
def live_clusters(spark, sf):
    keyed = user_posts(spark, sf)
    return keyed.select("cluster_id").distinct().join(trend.trend_summary(keyed, P), "cluster_id", "left_semi")
