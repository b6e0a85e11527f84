"""Table schemas and the parameter set shared by batch and streaming code."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

POST_COLUMNS = ["post_id", "title", "text", "source", "platform", "timestamp"]

POSTS_SCHEMA = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

SUBMISSIONS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
    ]
)

# State names in display order, and the label of unclustered posts.
STATE_ORDER = ["trending", "rising", "declining", "dormant"]
NOISE_LABEL = -1


@dataclass(frozen=True)
class TrendParams:
    """Knobs of the online clustering and of the trend scoring.

    ``snapshot_interval_seconds`` defaults to an eighth of a half-life.
    """

    similarity_threshold: float = 0.55
    half_life_seconds: float = 6 * 3600.0
    min_cluster_weight: float = 0.05
    window_size: int = 20
    snapshot_interval_seconds: float | None = None
    trending_growth: float = 0.25
    min_weight: float = 0.5
    burst_z_threshold: float = 2.5
    recent_titles: int = 8

    @property
    def interval_seconds(self) -> float:
        if self.snapshot_interval_seconds is not None:
            return self.snapshot_interval_seconds
        return self.half_life_seconds / 8.0

    @property
    def interval_micros(self) -> int:
        return int(round(self.interval_seconds * 1_000_000))

    @property
    def half_life_micros(self) -> float:
        return self.half_life_seconds * 1_000_000

    @property
    def steps_per_half_life(self) -> float:
        return self.half_life_micros / self.interval_micros

    def with_(self, **changes) -> "TrendParams":
        return replace(self, **changes)
