"""Raw submissions to posts; the same expression serves batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as tx
from tidewatch.functions import times

# Id prefix and platform of live submissions.
SUBMISSION_PREFIX, SUBMISSION_PLATFORM = "reddit_", "reddit"


def parse_submissions(raw: DataFrame) -> DataFrame:
    """Squeezes title and body, joins what is left, drops rows without any text."""
    title, body = tx.squeezed(F.col("title")), tx.squeezed(F.col("selftext"))
    filled = raw.filter(~(tx.is_blank(F.col("title")) & tx.is_blank(F.col("selftext"))))
    return filled.select(
        tx.prefixed_id(SUBMISSION_PREFIX, F.col("id")).alias("post_id"),
        title.alias("title"),
        tx.joined_parts(title, body).alias("text"),
        F.col("subreddit").cast("string").alias("source"),
        F.lit(SUBMISSION_PLATFORM).alias("platform"),
        times.from_epoch(F.col("created_utc")).alias("timestamp"),
    )
