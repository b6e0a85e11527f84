"""The live view: active clusters with their titles, labels and states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import labels, trend
from tidewatch.runtime import materialize
from tidewatch.schema import TrendParams


def active_summary(posts: DataFrame, p: TrendParams, auto_calibrate: bool = False) -> DataFrame:
    """Trend summary of live clusters with member count and newest titles.

    ``posts`` has ``cluster_id, post_id, title, timestamp``; only posts of live clusters reach the
    title ranking. Sorted by state name, fastest growth first.
    """
    summary = materialize(
        trend.trend_summary(posts.select("cluster_id", "timestamp"), p, auto_calibrate=auto_calibrate), "summary"
    )
    titled = posts.select("cluster_id", "post_id", "title", "timestamp").join(
        summary.select("cluster_id"), "cluster_id", "left_semi"
    )
    members = labels.member_summary(titled, keep=p.recent_titles)
    return summary.join(members, "cluster_id").orderBy("state", F.desc("growth_rate"), "cluster_id")


def trend_board(
    posts: DataFrame,
    p: TrendParams,
    auto_calibrate: bool = False,
    labeler: Callable[[DataFrame], DataFrame] = labels.topic_labels,
) -> DataFrame:
    """Cards of all live clusters with their labels, made for all clusters in one job.

    ``labeler`` turns titles (``cluster_id, post_id, title``) into ``cluster_id, label, description``.
    """
    summary = materialize(active_summary(posts, p, auto_calibrate), "active")
    live = summary.select("cluster_id")
    mine = posts.select("cluster_id", "post_id", "title", "timestamp").join(live, "cluster_id", "left_semi")
    recent = labels.recent_titles(mine, keep=p.recent_titles)
    named = labels.with_labels(summary, labeler(recent))
    return trend.board_order(named).drop("state_rank")
