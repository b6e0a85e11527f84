"""Cluster quality against reference labels, all from one contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.runtime import side_by_side
from tidewatch.schema import NOISE_LABEL


def contingency(df: DataFrame, true: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """Rows per pair of labels: ``group, true_label, pred_label, n``."""
    keys = group or []
    return df.groupBy(*keys, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(
        F.count("*").alias("n")
    )


def _pairs(n):
    n = n.cast("double")
    return F.sum(n * (n - 1) / 2)


def _nlogn(n):
    n = n.cast("double")
    return F.sum(n * F.log(n))


def quality_scores(cells: DataFrame, group: list[str] | None = None) -> DataFrame:
    """ARI, NMI, homogeneity, completeness, V-measure, cluster count and noise share per group.

    Pair counts and entropies need only sums over the cells and the two marginals. Noise counts as
    one cluster in the scores and is left out of ``n_clusters``.
    """
    keys = group or []
    joint = cells.groupBy(*keys).agg(
        F.sum("n").alias("n_posts"),
        _pairs(F.col("n")).alias("s"),
        _nlogn(F.col("n")).alias("j"),
        F.sum(F.when(F.col("pred_label") == NOISE_LABEL, F.col("n")).otherwise(0)).alias("noise"),
    )
    true_side = cells.groupBy(*keys, "true_label").agg(F.sum("n").alias("n"))
    pred_side = cells.groupBy(*keys, "pred_label").agg(F.sum("n").alias("n"))
    rows = true_side.groupBy(*keys).agg(_pairs(F.col("n")).alias("a"), _nlogn(F.col("n")).alias("ta"))
    cols = pred_side.groupBy(*keys).agg(
        _pairs(F.col("n")).alias("b"),
        _nlogn(F.col("n")).alias("tb"),
        F.count(F.when(F.col("pred_label") != NOISE_LABEL, 1)).alias("n_clusters"),
    )
    n = F.col("n_posts").cast("double")
    total = n * (n - 1) / 2
    expected = F.try_divide(F.col("a") * F.col("b"), total)
    best = (F.col("a") + F.col("b")) / 2
    same = (F.col("s") == F.col("a")) & (F.col("s") == F.col("b"))
    ari = F.when(same, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.col("s") - expected, best - expected), F.lit(1.0)))
    h_true = F.greatest(F.log(n) - F.col("ta") / n, F.lit(0.0))
    h_pred = F.greatest(F.log(n) - F.col("tb") / n, F.lit(0.0))
    h_both = F.log(n) - F.col("j") / n
    tiny = 1e-12
    return (
        side_by_side([joint, rows, cols], keys)
        .withColumn("ari", ari)
        .withColumn("_ht", h_true)
        .withColumn("_hp", h_pred)
        .withColumn("_mi", F.greatest(F.col("_ht") + F.col("_hp") - h_both, F.lit(0.0)))
        .withColumn("homogeneity", F.when(F.col("_ht") > tiny, F.col("_mi") / F.col("_ht")).otherwise(1.0))
        .withColumn("completeness", F.when(F.col("_hp") > tiny, F.col("_mi") / F.col("_hp")).otherwise(1.0))
        .withColumn(
            "nmi",
            F.when((F.col("_ht") <= tiny) & (F.col("_hp") <= tiny), 1.0).otherwise(
                F.col("_mi") / ((F.col("_ht") + F.col("_hp")) / 2)
            ),
        )
        .withColumn(
            "v_measure",
            F.coalesce(
                F.try_divide(
                    2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")
                ),
                F.lit(0.0),
            ),
        )
        .select(
            *(group or []),
            "ari",
            "nmi",
            "homogeneity",
            "completeness",
            "v_measure",
            "n_clusters",
            "n_posts",
            (F.col("noise") / n).alias("noise_ratio"),
        )
    )


def score_clusters(df: DataFrame, true: str, pred: str, group: list[str] | None = None) -> DataFrame:
    return quality_scores(contingency(df, true, pred, group), group)


def score_assignments(assignments: DataFrame, posts: DataFrame, label: str = "source", group: list[str] | None = None) -> DataFrame:
    """Scores assignments against a label column of the posts they belong to."""
    joined = assignments.select("post_id", "cluster_id", *[c for c in (group or []) if c in assignments.columns]).join(
        posts.select("post_id", label, *[c for c in (group or []) if c in posts.columns]), "post_id"
    )
    return score_clusters(joined, label, "cluster_id", group)


def score_per_platform(
    posts: DataFrame, labellings: dict[str, DataFrame], label: str = "source", min_posts: int = 10
) -> DataFrame:
    """Each labelling (``post_id, cluster_id``) scored per platform with at least ``min_posts`` posts."""
    spark = posts.sparkSession
    tagged = None
    for method, labels in labellings.items():
        part = labels.select("post_id", "cluster_id", F.lit(method).alias("method"))
        tagged = part if tagged is None else tagged.unionByName(part)
    if tagged is None:
        return spark.createDataFrame([], "platform string, method string")
    big = posts.groupBy("platform").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_posts).select("platform")
    scored = tagged.join(posts.select("post_id", "platform", label), "post_id").join(big, "platform", "left_semi")
    return score_clusters(scored, label, "cluster_id", ["platform", "method"])


def cluster_summary(df: DataFrame, label: str, title: str = "title", order: list | None = None, k: int = 3) -> DataFrame:
    """Size and first ``k`` titles per cluster, largest first and noise last.

    Sizes combine on the map side; the title rank is cut to ``k`` before the shuffle.
    """
    w = W.partitionBy(label).orderBy(*(order or ["timestamp", "post_id"]))
    first = df.select(label, title, F.row_number().over(w).alias("_rn")).filter(F.col("_rn") <= k)
    titles = first.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("_rn", title))).alias("_t"))
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    joined = sizes.join(titles, label).select(
        label, "size", F.array_join(F.transform("_t", lambda x: F.coalesce(x[title], F.lit(""))), " | ").alias("sample_titles")
    )
    return joined.orderBy(F.col(label) == NOISE_LABEL, F.desc("size"), label)


def noise_and_count(df: DataFrame, label: str) -> DataFrame:
    """One row ``n_clusters, noise_ratio``."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    noise = F.sum(F.when(F.col(label) == NOISE_LABEL, F.col("n")).otherwise(0))
    return sizes.agg(
        F.count(F.when(F.col(label) != NOISE_LABEL, 1)).alias("n_clusters"),
        F.coalesce(F.try_divide(noise.cast("double"), F.sum("n").cast("double")), F.lit(0.0)).alias("noise_ratio"),
    )


def size_histogram(df: DataFrame, label: str, bins: int = 30) -> DataFrame:
    """Clusters per size bin between the smallest and the largest size, noise left out."""
    sizes = df.filter(F.col(label) != NOISE_LABEL).groupBy(label).agg(F.count("*").alias("size"))
    edges = sizes.agg(F.min("size").alias("lo"), F.max("size").alias("hi")).first()
    lo, hi = edges["lo"] or 0, edges["hi"] or 0
    width = (hi - lo) / bins if hi > lo else 1.0
    at = F.least(F.floor((F.col("size") - lo) / F.lit(float(width))), F.lit(bins - 1)).cast("int")
    return (
        sizes.groupBy(at.alias("bin"))
        .agg(F.count("*").alias("n_clusters"))
        .select(
            "bin",
            (F.lit(float(lo)) + F.col("bin") * float(width)).alias("bin_start"),
            (F.lit(float(lo)) + (F.col("bin") + 1) * float(width)).alias("bin_end"),
            "n_clusters",
        )
    )
