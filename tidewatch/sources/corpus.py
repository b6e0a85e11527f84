"""The master table of posts: cleaning, keep-first, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import text as tx
from tidewatch.functions import times
from tidewatch.runtime import has_files
from tidewatch.schema import POST_COLUMNS
from tidewatch.sources.readers import require_columns


def keep_first(df: DataFrame, key: str = "post_id", order: list | None = None) -> DataFrame:
    """One row per key, the first by ``order``.

    The rank limit is applied before the shuffle too, so many copies of one key collapse early.
    """
    w = W.partitionBy(key).orderBy(*(order or ["timestamp", "text"]))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def clean_corpus(df: DataFrame) -> DataFrame:
    """Rows with text, first row of each id."""
    require_columns(df, POST_COLUMNS, "corpus")
    return keep_first(df.filter(~tx.is_blank(F.col("text"))))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return clean_corpus(spark.read.parquet(path))


def load_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """A master table kept as CSV with ISO-8601 timestamps."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    require_columns(raw, POST_COLUMNS, "corpus")
    return clean_corpus(raw.withColumn("timestamp", times.strict(F.col("timestamp"))))


def dropped_rows(raw: DataFrame, cleaned: DataFrame) -> int:
    return raw.count() - cleaned.count()


def new_rows(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows whose id the master table does not hold yet, one per id."""
    unseen = incoming.select(*POST_COLUMNS).join(existing.select("post_id"), "post_id", "left_anti")
    return keep_first(unseen).select(*POST_COLUMNS)


def merge_master(incoming: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Existing rows win over incoming rows of the same id."""
    if existing is None:
        return keep_first(incoming.select(*POST_COLUMNS))
    return existing.select(*POST_COLUMNS).unionByName(new_rows(incoming, existing))


def write_master(incoming: DataFrame, path: str) -> None:
    """Appends the rows the master table lacks, each file in time order; nothing is rewritten."""
    spark = incoming.sparkSession
    existing = spark.read.parquet(path) if has_files(spark, path) else None
    fresh = keep_first(incoming.select(*POST_COLUMNS)) if existing is None else new_rows(incoming, existing)
    fresh.sortWithinPartitions("timestamp", "post_id").write.mode("append").parquet(path)


def write_posts_csv(posts: DataFrame, path: str) -> None:
    """CSV copy of a posts table with ISO-8601 timestamps, in time order."""
    ordered = posts.select(*POST_COLUMNS).orderBy("timestamp", "post_id")
    ordered.withColumn("timestamp", times.iso(F.col("timestamp"))).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"'
    )


def most_recent(posts: DataFrame, n: int) -> DataFrame:
    return posts.orderBy(F.desc("timestamp"), F.desc("post_id")).limit(n)


def platform_or_all(posts: DataFrame, platform: str) -> DataFrame:
    """Posts of one platform; the whole table when it has none."""
    chosen = posts.filter(F.col("platform") == platform)
    return posts if chosen.isEmpty() else chosen
