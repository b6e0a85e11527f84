"""Growth, burst score, states and the weight series."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import BASE_US
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import scoring
from tidewatch.operators import trend, weights
from tidewatch.operators.quantiles import exact_quantile
from tidewatch.operators import quantiles
from tidewatch.schema import TrendParams

HOUR = TrendParams(half_life_seconds=3600.0, snapshot_interval_seconds=3600.0)


def history(spark, rows):
    g0 = BASE_US // HOUR.interval_micros
    data = [(c, g0 + i, w, 1) for c, ws in rows.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(data, "cluster_id bigint, g bigint, weight double, life bigint")


def latest(spark, rows, p=HOUR):
    states = trend.trend_states(trend.trend_features(history(spark, rows), p), p)
    pdf = states.toPandas().sort_values("g").groupby("cluster_id").tail(1).set_index("cluster_id")
    return pdf


def assignments(spark, times_us, cluster=None):
    pdf = pd.DataFrame(
        {"post_id": [f"p{i}" for i in range(len(times_us))], "cluster_id": cluster or [1] * len(times_us), "us": times_us}
    )
    df = spark.createDataFrame(pdf, "post_id string, cluster_id bigint, us bigint")
    return df.select("post_id", "cluster_id", F.timestamp_micros("us").alias("timestamp"))


def test_states_of_short_histories(spark):
    got = latest(spark, {1: [1.0], 2: [1.0, 0.5], 3: [1.0, 3.0], 4: [1.0, 1.05], 5: [1.0, 4.0], 6: [1.0, 1.0]})
    assert got.loc[1, "growth_rate"] == 0.0 and got.loc[1, "state"] == "dormant"
    assert got.loc[2, "growth_rate"] == pytest.approx(-0.5) and got.loc[2, "state"] == "declining"
    assert got.loc[3, "state"] == "trending" and got.loc[5, "state"] == "trending"
    assert 0 < got.loc[4, "growth_rate"] < 0.25 and got.loc[4, "state"] == "rising"
    assert got.loc[6, "state"] == "dormant"
    assert got.loc[2, "velocity"] == pytest.approx(-0.5 / 3600)


def test_light_burst_is_not_trending(spark):
    p = HOUR.with_(min_weight=5.0)
    assert latest(spark, {1: [1.0, 3.0], 2: [2.0, 1.0]}, p)["state"].tolist() == ["rising", "declining"]


def test_burst_score_covers_twenty_steps(spark):
    rng = np.random.default_rng(4)
    ws = np.exp(rng.normal(size=40)).tolist()
    got = latest(spark, {1: ws})
    steps = pd.Series(ws).diff() / pd.Series(ws).shift()
    last = steps.tail(20)
    assert got.loc[1, "burst_z"] == pytest.approx((last.iloc[-1] - last.mean()) / last.std())
    first = ws[-20]
    assert got.loc[1, "growth_rate"] == pytest.approx((ws[-1] - first) / first / 19)


def test_burst_score_needs_three_steps(spark):
    got = latest(spark, {1: [1.0, 2.0, 9.0], 2: [1.0, 2.0, 2.5, 9.0], 3: [1.0, 2.0, 4.0, 8.0, 16.0]})
    assert got.loc[1, "burst_z"] == 0.0 and got.loc[2, "burst_z"] > 0
    assert got.loc[3, "burst_z"] == 0.0  # equal steps have no spread


def test_one_idle_half_life_halves_the_weight(spark):
    df = assignments(spark, [BASE_US, BASE_US + 10 * 3_600_000_000], [1, 2])
    hist = weights.weight_history(df, HOUR).filter("cluster_id = 1").toPandas().sort_values("g")["weight"].tolist()
    assert hist == pytest.approx([2.0**-i for i in range(5)])  # 2^-4 is the last weight above 0.05


def test_very_long_history_does_not_overflow(spark):
    p = TrendParams(half_life_seconds=60.0, snapshot_interval_seconds=60.0)
    times = [BASE_US + i * 60_000_000 for i in range(3000)]
    hist = weights.weight_history(assignments(spark, times), p).toPandas().sort_values("g")
    assert len(hist) == 3000
    assert hist["weight"].iloc[-1] == pytest.approx(2.0, rel=1e-9)
    assert np.isfinite(hist["weight"]).all()


def test_returning_key_starts_a_new_life(spark):
    df = assignments(spark, [BASE_US, BASE_US + 30 * 3_600_000_000])
    hist = weights.weight_history(df, HOUR).toPandas()
    assert sorted(hist["life"].unique()) == [1, 2]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 200 * 3_600_000_000), min_size=1, max_size=60))
def test_post_weight_equals_stepwise_decay(spark, offsets):
    us = sorted(BASE_US + o for o in offsets)
    got = weights.post_weights(assignments(spark, us), HOUR).toPandas()
    got["n"] = got["post_id"].str[1:].astype(int)
    want, w, last = [], 0.0, us[0]
    for t in us:
        w, last = w * 2.0 ** (-(t - last) / HOUR.half_life_micros) + 1.0, t
        want.append(w)
    # posts of one instant are taken in id order, so compare the sorted weights of each instant
    by_time = pd.DataFrame({"t": us, "w": want}).groupby("t")["w"].apply(sorted)
    mine = got.assign(t=[us[i] for i in got["n"]]).groupby("t")["weight"].apply(sorted)
    for a, b in zip(by_time, mine):
        assert a == pytest.approx(b, rel=1e-9)


def test_summary_equals_full_history(spark):
    rng = np.random.default_rng(2)
    us = np.sort(BASE_US + rng.integers(0, 90 * 3_600_000_000, 600))
    df = assignments(spark, us.tolist(), rng.integers(0, 20, 600).tolist())
    last = weights.last_grid_number(df, HOUR)
    full = trend.trend_states(trend.trend_features(weights.weight_history(df, HOUR), HOUR), HOUR).filter(F.col("g") == last)
    a = full.toPandas().set_index("cluster_id").sort_index()
    b = trend.trend_summary(df, HOUR).toPandas().set_index("cluster_id").sort_index()
    assert a.index.tolist() == b.index.tolist() and a["state"].tolist() == b["state"].tolist()
    for c in ("weight", "growth_rate", "burst_z", "velocity"):
        assert a[c].to_numpy() == pytest.approx(b[c].to_numpy(), rel=1e-9, abs=1e-12)


def test_first_state_is_logged_and_repeats_are_not(spark):
    log = trend.state_transitions(
        history(spark, {1: [1.0, 1.0, 3.0, 9.0, 4.0]}).withColumn("grid_ts", F.timestamp_micros(F.col("g") * HOUR.interval_micros)), HOUR
    ).orderBy("timestamp")
    assert [r["state"] for r in log.collect()] == ["dormant", "trending"]


def test_cutoff_needs_five_clusters_and_never_falls_below_the_default(spark):
    few = spark.createDataFrame([(1.0, 5.0)] * 4, "weight double, growth_rate double")
    many = spark.createDataFrame([(1.0, float(i)) for i in range(11)], "weight double, growth_rate double")
    low = spark.createDataFrame([(1.0, -1.0)] * 9, "weight double, growth_rate double")
    assert trend.calibrated_cutoff(few, HOUR) == 0.25
    assert trend.calibrated_cutoff(many, HOUR) == pytest.approx(9.5)
    assert trend.calibrated_cutoff(low, HOUR) == 0.25


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.95, 1.0])
def test_exact_quantile_through_narrowed_brackets(spark, q, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET_MAX_VALUES", 50)
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=4000), np.zeros(2000)])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got, n = exact_quantile(df, "v", q)
    assert n == 6000 and got == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_state_mix_lists_all_states(spark):
    summary = spark.createDataFrame([("rising",), ("rising",), ("dormant",)], "state string")
    got = {r["state"]: r["n_clusters"] for r in trend.state_mix(summary).collect()}
    assert got == {"trending": 0, "rising": 2, "declining": 0, "dormant": 1}


def test_empty_assignments_keep_their_columns(spark):
    empty = spark.createDataFrame([], "cluster_id bigint, timestamp timestamp")
    got = trend.trend_summary(empty, HOUR)
    assert got.count() == 0 and "state" in got.columns


def test_state_rank_puts_unknown_last(spark):
    df = spark.createDataFrame([("trending",), ("dormant",), ("odd",)], "s string")
    assert [r[0] for r in df.select(scoring.state_rank(F.col("s"))).collect()] == [0, 3, 4]


def test_no_decay_for_time_running_backwards(spark):
    df = spark.createDataFrame([(-5.0,), (3600.0,)], "dt double")
    assert [r[0] for r in df.select(scoring.decay_factor(F.col("dt"), 3600.0)).collect()] == [1.0, 0.5]
    assert math.isclose(2.0**-1, 0.5)
