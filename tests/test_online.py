"""Online clustering against a plain step-by-step loop."""

import numpy as np
import pandas as pd
import pytest
from conftest import BASE_US
from pyspark.sql import functions as F

from tidewatch.operators import online, trend, weights
from tidewatch.operators.components import connected_components
from tidewatch.plans.replay import replay
from tidewatch.schema import TrendParams

P = TrendParams(half_life_seconds=3600.0, similarity_threshold=0.8)


def plain_loop(us, vectors, p):
    """One post at a time: decay every weight, drop light clusters, match or found."""
    clusters, out, last = [], [], us[0]
    for i, (t, x) in enumerate(zip(us, vectors)):
        f = 2.0 ** (-(t - last) / p.half_life_micros)
        last = t
        for c in clusters:
            c["w"] *= f
        clusters = [c for c in clusters if c["w"] >= p.min_cluster_weight]
        sims = [float(c["c"] @ x) for c in clusters]
        if sims and max(sims) >= p.similarity_threshold:
            c = clusters[int(np.argmax(sims))]
            v = c["c"] * c["w"] + x
            c["c"], c["w"] = v / np.linalg.norm(v), c["w"] + 1
        else:
            c = {"c": x / np.linalg.norm(x), "w": 1.0, "id": i}
            clusters.append(c)
        out.append(c["id"])
    return out


def make_posts(spark, us, vectors):
    pdf = pd.DataFrame(
        {"post_id": [f"p{i:06d}" for i in range(len(us))], "us": us, "embedding": [[float(v) for v in x] for x in vectors]}
    )
    df = spark.createDataFrame(pdf, "post_id string, us bigint, embedding array<float>")
    return df.select("post_id", F.timestamp_micros("us").alias("timestamp"), "embedding", F.col("post_id").alias("title"))


def noisy_corpus(topic_vector, n=1500, topics=12, seed=3):
    rng = np.random.default_rng(seed)
    us = BASE_US + np.sort(rng.integers(0, 40 * 3600 * 1_000_000, size=n))
    keys = rng.integers(0, topics, size=n)
    x = np.stack([topic_vector(int(k)) for k in keys]) + rng.normal(scale=0.05, size=(n, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return us, x, keys


def groups(ids):
    """Partition as a canonical list: each element's first companion."""
    first = {}
    return [first.setdefault(c, i) for i, c in enumerate(ids)]


def test_equals_plain_loop(spark, topic_vector):
    us, x, _ = noisy_corpus(topic_vector)
    got = online.online_clusters(make_posts(spark, us, x), P).orderBy("post_id").toPandas()
    assert groups(got["cluster_id"]) == groups(plain_loop(us, x, P))


def test_pairs_at_the_default_threshold_are_met(spark):
    """Two posts with a cosine of 0.56, hours apart, are one cluster by the plain loop; so must they be here."""
    rng = np.random.default_rng(6)
    p = P.with_(similarity_threshold=0.55, half_life_seconds=3600.0)
    q = np.linalg.qr(rng.normal(size=(256, 256)))[0]
    a, other = q[:100], q[100:200]
    x = np.concatenate([a, 0.56 * a + np.sqrt(1 - 0.56**2) * other]).astype(np.float32)
    us = BASE_US + np.repeat([0, 90 * 60], 100) * 1_000_000 + np.arange(200)
    expected = groups(plain_loop(us, x, p))
    got = online.online_clusters(make_posts(spark, us, x), p).orderBy("post_id").toPandas()
    assert expected == [*range(100), *range(100)]
    assert groups(got["cluster_id"]) == expected


def test_idle_topic_dies_and_returns_as_new_cluster(spark, topic_vector):
    hours = [0, 0.5, 40, 40.5]
    us = [BASE_US + int(h * 3.6e9) for h in hours]
    got = online.online_clusters(make_posts(spark, us, [topic_vector(1)] * 4), P).orderBy("post_id").toPandas()
    ids = got["cluster_id"].tolist()
    assert ids[0] == ids[1] and ids[2] == ids[3] and ids[0] != ids[2]


def test_weight_series_matches_stepwise_decay(spark, topic_vector):
    us, x, _ = noisy_corpus(topic_vector, n=400)
    posts = make_posts(spark, us, x)
    assigned = online.online_clusters(posts, P)
    hist = weights.weight_history(assigned, P).toPandas()
    rows = assigned.toPandas()
    at = rows["timestamp"].astype("int64") // (1 if str(rows["timestamp"].dtype).endswith("us]") else 1000)
    grid = hist["g"].to_numpy() * P.interval_micros
    for c, g, w in zip(hist["cluster_id"], grid, hist["weight"]):
        mine = at[(rows["cluster_id"] == c) & (at <= g)]
        assert w == pytest.approx(float((2.0 ** (-(g - mine) / P.half_life_micros)).sum()), rel=1e-9)
    assert (hist["weight"] >= P.min_cluster_weight).all()


@pytest.mark.parametrize("bits, coarse_bits", [(10, 3), (14, 8)])
def test_cell_widths_keep_every_post_and_every_topic(spark, topic_vector, bits, coarse_bits):
    """Far apart topics, one of them with a third of all posts: other cells must give the same groups."""
    rng = np.random.default_rng(5)
    n = 900
    us = BASE_US + np.sort(rng.integers(0, 6 * 3600 * 1_000_000, size=n))
    keys = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 6, size=n))
    x = np.stack([topic_vector(int(k)) for k in keys])
    posts = make_posts(spark, us, x)
    whole = online.online_clusters(posts, P).orderBy("post_id").toPandas()
    cut = online.online_clusters(posts, P, bits, coarse_bits).orderBy("post_id").toPandas()
    assert len(cut) == n and cut["post_id"].is_unique
    assert groups(cut["cluster_id"]) == groups(whole["cluster_id"]) == groups(plain_loop(us, x, P))


def test_result_does_not_depend_on_partitions(spark, topic_vector):
    us, x, _ = noisy_corpus(topic_vector, n=300)
    posts = make_posts(spark, us, x)
    a = online.online_clusters(posts.repartition(1), P).orderBy("post_id").toPandas()
    b = online.online_clusters(posts.repartition(7), P).orderBy("post_id").toPandas()
    assert a["cluster_id"].tolist() == b["cluster_id"].tolist()


def test_unrelated_posts_change_nothing(spark, topic_vector):
    us, x, keys = noisy_corpus(topic_vector, n=600)
    posts = make_posts(spark, us, x)
    some = posts.join(spark.createDataFrame([(f"p{i:06d}",) for i in np.flatnonzero(keys < 8)], "post_id string"), "post_id")
    a = online.online_clusters(posts, P).join(some.select("post_id"), "post_id").orderBy("post_id").toPandas()
    b = online.online_clusters(some, P).orderBy("post_id").toPandas()
    assert a["cluster_id"].tolist() == b["cluster_id"].tolist()


def test_runs_share_a_job_and_equal_single_runs(spark, topic_vector):
    us, x, _ = noisy_corpus(topic_vector, n=300)
    posts = make_posts(spark, us, x)
    grid = {"a": P, "b": P.with_(half_life_seconds=7200.0), "c": P.with_(similarity_threshold=0.97)}
    both = online.online_runs(posts, grid).toPandas()
    for run, p in grid.items():
        one = online.online_clusters(posts, p).toPandas().set_index("post_id")["cluster_id"]
        mine = both[both["run"] == run].set_index("post_id")["cluster_id"]
        assert mine.sort_index().equals(one.sort_index())


def test_empty_table_and_zero_vectors(spark, topic_vector):
    us = [BASE_US + i * 60_000_000 for i in range(4)]
    posts = make_posts(spark, us, [topic_vector(1), np.zeros(32), topic_vector(1), np.zeros(32)])
    ids = online.online_clusters(posts, P).orderBy("post_id").toPandas()["cluster_id"].tolist()
    assert ids[0] == ids[2] and len(set(ids)) == 3
    assert online.online_clusters(posts.limit(0), P).count() == 0


def test_replay_tables(spark, topic_vector):
    us = [BASE_US + i * 30_000_000 for i in range(120)]
    posts = make_posts(spark, us, [topic_vector(0)] * 120)
    p = P.with_(snapshot_interval_seconds=60.0)
    run = replay(posts, p, vectors=posts.select("post_id", "embedding"))
    assert run.assignments.count() == 120
    summary = run.summary.toPandas()
    assert summary["state"].tolist() == ["trending"]
    assert summary["member_count"].tolist() == [120]
    assert summary["sample_titles"][0] == " | ".join(f"p{i:06d}" for i in range(115, 120))
    assert run.state_log.filter("state = 'trending'").count() >= 1
    assert set(run.history.columns) == {"cluster_id", "timestamp", "weight"}


def test_idle_cluster_is_declining(spark, topic_vector):
    hours = [0] + [0.5 * i for i in range(1, 12)]
    us = [BASE_US + int(h * 3.6e9) for h in hours]
    vectors = [topic_vector(0)] + [topic_vector(100 + i) for i in range(1, 12)]
    p = P.with_(snapshot_interval_seconds=900.0, min_cluster_weight=1e-6, min_weight=0.0, similarity_threshold=0.95)
    run = online.online_clusters(make_posts(spark, us, vectors), p)
    states = trend.trend_summary(run, p).toPandas()["state"]
    assert "declining" in set(states)


def test_components_match_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).toPandas()
    assert dict(zip(got["node"], got["component"])) == {a: find(a) for a in parent}


def test_many_leaders_are_scored_in_products(monkeypatch):
    """Summaries of a wide group are scored some at a time and join what they join one by one, ties and moved leaders included."""
    rng = np.random.default_rng(15)
    base = rng.choice([-1.0, 1.0], size=(400, 64))
    x = base[rng.integers(0, 400, 3000)] * np.where(rng.random((3000, 64)) < 1 / 16, -1.0, 1.0)
    x[1000:1200] = x[:200]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    names, us, mass = [f"p{k}" for k in range(3000)], list(range(3000)), rng.random(3000).tolist()
    one, many, products = online._Leaders(0.55, 64), online._Leaders(0.55, 64), []
    scored = online._Leaders._join_scored
    monkeypatch.setattr(online._Leaders, "_join_scored", lambda self, *a: products.append(len(a[0])) or scored(self, *a))
    monkeypatch.setattr(online, "SCORED", 100)
    want = [one.join(*row) for row in zip(names, us, x, unit, mass)]
    assert many.join_all(names, us, x, unit, mass) == want
    assert many.heads == one.heads and many.mass == one.mass
    assert np.array_equal(many.sums[: len(one.heads)], one.sums[: len(one.heads)])
    assert len(products) < 40 and sum(products) > 2000
