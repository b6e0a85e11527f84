"""Bursts taken from the events, against plain loops."""

import numpy as np
import pandas as pd
import pytest

from tidewatch.queries import QUERIES, bursts, load_all

load_all()
SIX_HOURS = 6 * 3_600_000_000


def events(n, seed):
    rng = np.random.default_rng(seed)
    us = 1_704_067_200_000_000 + rng.integers(0, 10 * SIX_HOURS, n)
    us[: n // 3] = 1_704_067_200_000_000 + 3 * SIX_HOURS + rng.integers(0, SIX_HOURS, n // 3)  # a third of all in one place
    kinds = rng.choice(["a", "b", "c"], n)
    kinds[: n // 3] = "a"
    return pd.DataFrame({"event_id": np.arange(n), "us": us, "user_id": rng.integers(0, 9, n), "event_type": kinds})


@pytest.fixture
def saved(spark, tmp_path):
    def save(rows):
        df = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string")
        df.selectExpr("event_id", "timestamp_micros(us) AS ts", "user_id", "event_type", "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
        return str(tmp_path)

    return save


def test_truth_is_the_busiest_window_of_each_type(spark, saved):
    rows = events(300, 1)
    sf = saved(rows)
    truth = bursts._truth(spark, sf).toPandas().sort_values("burst_id")
    want = []
    for kind, part in rows.groupby("event_type"):
        counts = (part["us"] // SIX_HOURS).value_counts()
        slot = min(counts[counts == counts.max()].index)
        inside = part["us"][part["us"] // SIX_HOURS == slot]
        want.append((kind, slot * SIX_HOURS, slot * SIX_HOURS + int((inside - slot * SIX_HOURS).sum()) // len(inside), len(inside)))
    us = lambda c: [int(x.value // 1000) for x in truth[c]]
    assert list(zip(truth["topic_label"], us("burst_start"), us("peak"), truth["n_posts"])) == want
    assert truth["burst_id"].tolist() == [0, 1, 2]


def test_every_event_is_one_post(spark, saved):
    rows = events(300, 2)
    sf = saved(rows)
    truth = bursts._truth(spark, sf)
    placed = bursts._placed(spark, sf, truth).toPandas()
    assert len(placed) == 300 and placed["post_id"].is_unique
    assert placed["burst_id"].notna().sum() == truth.toPandas()["n_posts"].sum()
    quiet = placed[placed["burst_id"].isna()]
    assert quiet["post_id"].str.startswith("ev_").all() and (quiet["cluster_id"] < 9).all()


def test_no_events_no_bursts(spark, saved):
    sf = saved(events(300, 3).head(0))
    assert bursts._truth(spark, sf).isEmpty() and QUERIES["burst_posts"](spark, sf).isEmpty()
