"""A corpus replayed through the online clustering, with the trend tables that follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import embedding, trend, weights
from tidewatch.operators.online import online_clusters
from tidewatch.plans import board
from tidewatch.runtime import materialize
from tidewatch.schema import TrendParams


@dataclass
class Replay:
    """Assignments per post, weight history, summary of live clusters, and state changes."""

    assignments: DataFrame
    history: DataFrame
    summary: DataFrame
    state_log: DataFrame


def replay(
    posts: DataFrame,
    p: TrendParams | None = None,
    embedder: embedding.Embedder | None = None,
    store_path: str | None = None,
    text_mode: str = "text",
    vectors: DataFrame | None = None,
) -> Replay:
    """Embeds (or takes ``vectors``), clusters in time order, and derives the trend tables."""
    p = p or TrendParams()
    if vectors is None:
        if store_path is not None:
            vectors = embedding.embed_corpus_cached(posts, store_path, embedder, text_mode)
        else:
            # several passes follow, and a model should see each text once
            vectors = materialize(embedding.embed_corpus(posts, embedder, text_mode), "vectors")
    timed = posts.select("post_id", "timestamp").join(vectors.select("post_id", "embedding"), "post_id")
    assignments = materialize(online_clusters(timed, p), "assignments")
    history = weights.weight_history(assignments, p)
    titled = assignments.join(posts.select("post_id", "title"), "post_id")
    return Replay(
        assignments=assignments,
        history=history.select("cluster_id", F.col("grid_ts").alias("timestamp"), "weight"),
        summary=board.active_summary(titled, p),
        state_log=trend.state_transitions(history, p),
    )
