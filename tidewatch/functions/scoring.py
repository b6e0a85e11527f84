"""Scores and states as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schema import STATE_ORDER, TrendParams

# Fixed value: growth closer to zero than this counts as flat, and no ratio divides by less.
EPS = 1e-9


def decay_factor(elapsed_seconds: Column, half_life_seconds: float) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(elapsed_seconds, F.lit(0.0)) / F.lit(half_life_seconds))


def state_of(growth: Column, weight: Column, burst_z: Column, p: TrendParams, cutoff: Column | None = None) -> Column:
    """Trending, rising, declining or dormant."""
    limit = cutoff if cutoff is not None else F.lit(p.trending_growth)
    bursting = (growth >= limit) | (burst_z >= p.burst_z_threshold)
    return (
        F.when(bursting & (weight >= p.min_weight), "trending")
        .when(growth > EPS, "rising")
        .when(growth < -EPS, "declining")
        .otherwise("dormant")
    )


def state_rank(state: Column) -> Column:
    """Display position of a state, unknown states last."""
    pos = F.array_position(F.array(*[F.lit(s) for s in STATE_ORDER]), state)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(STATE_ORDER))).cast("int")


def combined_score(ari: Column, f1: Column) -> Column:
    return (F.greatest(ari, F.lit(0.0)) + f1) / 2.0


def safe_ratio(num: Column, den: Column) -> Column:
    """Quotient, zero when the denominator is zero or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def surging(is_new: Column, size: Column, growth_ratio: Column, ratio: float = 2.0, min_new: int = 5) -> Column:
    """New and large enough, or known and growing fast; the two cases never mix."""
    return F.when(is_new, size >= min_new).otherwise(growth_ratio >= ratio)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """Vector scaled to length one; a zero vector stays as it is."""
    doubles = v.cast("array<double>")

    def scaled(square: Column) -> Column:
        return F.when(square > 0, F.transform(doubles, lambda x: x / F.sqrt(square))).otherwise(doubles)

    # the sum is bound once as the variable of the last step, not worked out again per entry
    return F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x, scaled)
