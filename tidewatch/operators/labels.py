"""Topic labels: the heaviest TF-IDF terms of each cluster's titles, for all clusters in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import text as tx
from tidewatch.operators.stopwords import STOP_WORDS
from tidewatch.runtime import broadcast_if_small, materialize

# Token pattern, vocabulary size and number of label terms, fallback texts.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
MAX_TERMS = 50
TOP_TERMS = 3
FALLBACK_TITLE_CHARS = 60
UNLABELED = "Unlabeled topic"
NO_TITLES = "No sample titles available."


def words_of(title: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-case words of two or more characters without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(title), F.lit(TOKEN_PATTERN), F.lit(0)), lambda w: ~w.isin(stop_words))


def _candidates(docs: DataFrame, cluster: str, doc: str, title: str, stop_words: list[str], max_terms: int) -> DataFrame:
    """``cluster, doc, term, tf`` of all terms that may be among the ``max_terms`` most frequent words and pairs of their cluster.

    A pair is no more frequent than either of its words. So where ``max_terms`` words are more frequent than a word, neither it
    nor a pair with it is among the most frequent terms, and the pairs of all other words need not be counted.
    """
    read = docs.select(cluster, doc, words_of(F.col(title), stop_words).alias("words"))
    totals = read.select(cluster, F.explode("words").alias("word")).groupBy(cluster, "word").agg(F.count("*").alias("total"))
    ranked = totals.withColumn("rk", F.rank().over(W.partitionBy(cluster).orderBy(F.desc("total"))))
    frequent = broadcast_if_small(ranked.filter((F.col("rk") <= max_terms) & F.col(cluster).isNotNull()).select(cluster, "word"))
    next_ones = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))
    neighbours = F.zip_with("words", next_ones, lambda a, b: F.struct(a.alias("word"), b.alias("next")))
    pairs = read.select(cluster, doc, F.inline(neighbours)).join(frequent, [cluster, "word"])
    follows = frequent.select(cluster, F.col("word").alias("next"), F.lit(True).alias("paired"))
    terms = F.array("word", F.when(F.col("paired"), F.concat_ws(" ", "word", "next")))
    counted = pairs.join(follows, [cluster, "next"], "left").select(cluster, doc, F.explode(terms).alias("term"))
    return counted.filter("term is not null").groupBy(cluster, doc, "term").agg(F.count("*").alias("tf"))


def term_scores(
    titles: DataFrame,
    cluster: str = "cluster_id",
    doc: str = "post_id",
    title: str = "title",
    stop_words: list[str] = STOP_WORDS,
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """Summed TF-IDF weight of each cluster's most frequent terms: ``cluster, term, score``.

    The terms are words and pairs of neighbouring words. The vocabulary is the ``max_terms`` most frequent terms of a cluster;
    document rows are scaled to length one.
    """
    docs = titles.filter(~tx.is_blank(F.col(title))).select(cluster, doc, title)
    sizes = docs.groupBy(cluster).agg(F.count("*").alias("n_docs"))
    counts = materialize(_candidates(docs, cluster, doc, title, stop_words, max_terms), "counts")
    totals = counts.groupBy(cluster, "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    ranked = totals.withColumn(
        "rn", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("total"), F.asc("term")))
    )
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    vocabulary = ranked.filter(F.col("rn") <= max_terms).join(sizes, cluster).select(cluster, "term", idf.alias("idf"))
    weights = counts.join(broadcast_if_small(vocabulary), [cluster, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(cluster, doc)))
    return weights.withColumn("w", F.col("w") / norm).groupBy(cluster, "term").agg(F.sum("w").alias("score"))


def _rounded(c: Column) -> Column:
    return F.round(c, 9)


def top_terms(scores: DataFrame, cluster: str = "cluster_id", k: int = TOP_TERMS) -> DataFrame:
    """The ``k`` heaviest terms per cluster; equal scores go to the later term."""
    order = W.partitionBy(cluster).orderBy(F.desc(_rounded(F.col("score"))), F.desc("term"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topic_labels(
    titles: DataFrame,
    cluster: str = "cluster_id",
    doc: str = "post_id",
    title: str = "title",
    stop_words: list[str] = STOP_WORDS,
) -> DataFrame:
    """``cluster, label, description`` for every cluster in ``titles`` (first title by ``doc`` order)."""
    best = top_terms(term_scores(titles, cluster, doc, title, stop_words), cluster)
    joined = best.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
    label = F.array_join(F.transform("_t", lambda x: F.initcap(x["term"])), " / ")
    filled = ~tx.is_blank(F.col(title))
    heads = titles.groupBy(cluster).agg(
        F.count(F.when(filled, 1)).alias("_n"),
        F.min(F.when(filled, F.struct(F.col(doc).alias("d"), F.col(title).alias("t")))).alias("_first"),
    )
    first = F.col("_first.t")
    return heads.join(joined, cluster, "left").select(
        cluster,
        F.when(F.col("_n") == 0, UNLABELED)
        .when(F.col("_t").isNull(), F.substring(first, 1, FALLBACK_TITLE_CHARS))
        .otherwise(label)
        .alias("label"),
        F.when(F.col("_n") == 0, NO_TITLES)
        .otherwise(F.concat(F.col("_n").cast("string"), F.lit(' related posts, e.g. "'), first, F.lit('"')))
        .alias("description"),
    )


def with_labels(summary: DataFrame, labels: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Labels onto a summary, empty where a cluster has none."""
    joined = summary.join(labels, cluster, "left")
    return joined.withColumn("label", F.coalesce("label", F.lit(""))).withColumn(
        "description", F.coalesce("description", F.lit(""))
    )


def recent_titles(assignments: DataFrame, cluster: str = "cluster_id", keep: int = 8) -> DataFrame:
    """The newest ``keep`` titled posts per cluster, cut before the shuffle."""
    newest = W.partitionBy(cluster).orderBy(F.desc("timestamp"), F.desc("post_id"))
    return assignments.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= keep)


def member_summary(assignments: DataFrame, cluster: str = "cluster_id", shown: int = 5, keep: int = 8) -> DataFrame:
    """``cluster, member_count, sample_titles``: the last titles, oldest of them first."""
    counts = assignments.groupBy(cluster).agg(F.count("*").alias("member_count"))
    recent = recent_titles(assignments.select(cluster, "timestamp", "post_id", "title"), cluster, keep)
    lists = (
        recent.filter(F.col("recency") <= shown)
        .groupBy(cluster)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("r"), "title"))).alias("_t"))
    )
    return counts.join(lists, cluster).select(
        cluster,
        "member_count",
        F.array_join(F.transform("_t", lambda x: F.coalesce(x["title"], F.lit(""))), " | ").alias("sample_titles"),
    )
