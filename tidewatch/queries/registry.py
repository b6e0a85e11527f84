"""Query registry and the views the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as tx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with its SQL if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its zone-less times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without text, one per event."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("post_id"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("platform"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


SQL_EVENT_POSTS = """event_posts AS (
  SELECT 'ev_' || event_id AS post_id, event_type AS source, 'p' || (user_id % 4) AS platform, ts FROM events)"""


def user_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events keyed by user: assignments without vectors."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("post_id"),
        F.col("user_id").alias("cluster_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


SQL_USER_POSTS = """user_posts AS (
  SELECT 'ev_' || event_id AS post_id, user_id AS cluster_id, ts FROM events)"""


def _titled(docs: DataFrame) -> DataFrame:
    """Adds the title before documents are joined, so that whole texts move only where they are read."""
    return docs.withColumn("title", tx.title_prefix(F.col("text")))


def doc_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per document, at the time of the event of the same number, or that many seconds after the epoch where there is none."""
    docs = _titled(table(spark, sf_dir, "documents"))
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return docs.join(ev, F.col("doc_id") == F.col("event_id"), "left").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("post_id"),
        "title",
        "text",
        "source",
        F.concat(F.lit("p"), (F.coalesce("user_id", "doc_id") % 4).cast("string")).alias("platform"),
        F.coalesce(F.col("ts").cast("timestamp"), F.timestamp_seconds("doc_id")).alias("timestamp"),
        "lang",
    )


SQL_DOC_POSTS = """doc_posts AS (
  SELECT 'doc_' || doc_id AS post_id, substr(text, 1, 80) AS title, text, source,
         'p' || (coalesce(user_id, doc_id) % 4) AS platform, coalesce(ts, make_timestamp(doc_id * 1000000)) AS ts, lang
  FROM documents LEFT JOIN events ON doc_id = event_id)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per event; texts come round-robin from the documents."""
    docs = _titled(table(spark, sf_dir, "documents"))
    ev = table(spark, sf_dir, "events")
    n_docs = docs.count()
    return ev.join(docs, F.col("event_id") % n_docs == F.col("doc_id")).select(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("post_id"),
        "title",
        "text",
        F.col("event_type").alias("source"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("platform"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").alias("cluster_id"),
    )


SQL_POSTS = """posts AS (
  SELECT 'ev_' || event_id AS post_id, substr(text, 1, 80) AS title, text, event_type AS source,
         'p' || (user_id % 4) AS platform, ts, user_id AS cluster_id
  FROM events JOIN documents ON event_id % (SELECT count(*) FROM documents) = doc_id)"""

ISO_SQL = "'%Y-%m-%dT%H:%M:%S.%f+00:00'"


def iso_sql(expr: str) -> str:
    return f"strftime({expr}, {ISO_SQL})"
