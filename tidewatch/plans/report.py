"""Evaluation results as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluation_report(sections: dict[str, DataFrame]) -> DataFrame:
    """``section, metric, value`` from one-row tables of numbers; text columns are left out."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    parts = []
    for section, df in sections.items():
        metrics = [c for c, t in df.dtypes if t in numeric or t.startswith("decimal")]
        doubles = df.select(*[F.col(c).cast("double").alias(c) for c in metrics])
        long = doubles.unpivot([], metrics, "metric", "value").filter(F.col("value").isNotNull())
        parts.append(long.select(F.lit(section).alias("section"), "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def full_report(
    static: DataFrame | None = None,
    dynamic: DataFrame | None = None,
    burst: DataFrame | None = None,
    sliding_window_burst: DataFrame | None = None,
    sweep: DataFrame | None = None,
) -> DataFrame:
    """The report of an evaluation run from whichever results there are, with the best sweep row."""
    sections = {"static": static, "dynamic": dynamic, "burst": burst, "sliding_window_burst": sliding_window_burst}
    given = {name: df for name, df in sections.items() if df is not None}
    if sweep is not None and not sweep.isEmpty():
        given["sweep_best"] = best_row(sweep)
    if not given:
        raise ValueError("there are no results to report")
    return evaluation_report(given)


def best_row(sweep: DataFrame) -> DataFrame:
    """The winning row of a sweep; an empty sweep is an error."""
    ordered = sweep.orderBy(F.desc("combined_score"), "similarity_threshold", "half_life_hours", "text_mode")
    best = ordered.limit(1)
    if best.isEmpty():
        raise ValueError("the sweep has no rows")
    return best
