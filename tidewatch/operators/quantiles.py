"""Exact quantiles of a whole column without gathering the column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most this many distinct values are brought to the driver for the last step.
BRACKET_MAX_VALUES = 20_000
ACCURACY = 10_000


def exact_quantile(df: DataFrame, column: str, q: float) -> tuple[float | None, int]:
    """The ``q`` quantile with linear interpolation, and the number of non-null values.

    Approximate quantiles bracket the two ranks needed; the bracket is narrowed until its distinct
    values with their counts are few, and the ranks are read off them.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = values.count()
    if n == 0:
        return None, 0
    rank = q * (n - 1)
    low_rank, high_rank = math.floor(rank), math.ceil(rank)
    low, high, below = None, None, 0
    while True:
        inside = values
        if low is not None:
            inside = inside.filter((F.col("v") >= low) & (F.col("v") <= high))
        counts = inside.groupBy("v").agg(F.count("*").alias("n"))
        rows = counts.limit(BRACKET_MAX_VALUES + 1).collect()
        if len(rows) <= BRACKET_MAX_VALUES:
            break
        total = inside.count()
        margin = 4.0 / ACCURACY
        share_low = max(0.0, (low_rank - below) / total - margin)
        share_high = min(1.0, (high_rank - below + 1) / total + margin)
        picked = inside.agg(F.percentile_approx("v", [share_low, share_high], ACCURACY).alias("b")).first()["b"]
        low, high = picked[0], picked[1]
        below = values.filter(F.col("v") < low).count()
    found = {}
    seen = below
    for row in sorted(rows, key=lambda r: r["v"]):
        for want in (low_rank, high_rank):
            if want not in found and seen <= want < seen + row["n"]:
                found[want] = row["v"]
        seen += row["n"]
    a, b = found[low_rank], found[high_rank]
    return a + (b - a) * (rank - low_rank), n
