"""Quality scores, burst injection and scoring, labels, best matches, sliding windows."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import BASE_US
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import scoring
from tidewatch.operators import bursts, injection, labels, quality, similarity, sliding
from tidewatch.plans import evaluation, report
from tidewatch.plans.sliding import evaluate_sliding, recluster_windows
from tidewatch.plans.static import cluster_corpus
from tidewatch.schema import TrendParams

T0 = dt.datetime(2026, 1, 1)


def hours(h):
    return T0 + dt.timedelta(hours=h)


def pair_scores(a, b):
    """ARI and NMI from all pairs and from the joint distribution."""
    n = len(a)
    same_a = [(a[i] == a[j]) for i in range(n) for j in range(i)]
    same_b = [(b[i] == b[j]) for i in range(n) for j in range(i)]
    s = sum(x and y for x, y in zip(same_a, same_b))
    sa, sb, t = sum(same_a), sum(same_b), len(same_a)
    ari = 1.0 if s == sa == sb else (s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)

    def entropy(v):
        return -sum(v.count(x) / n * math.log(v.count(x) / n) for x in set(v))

    h, k, j = entropy(a), entropy(b), entropy(list(zip(a, b)))
    nmi = 1.0 if h < 1e-12 and k < 1e-12 else (h + k - j) / ((h + k) / 2)
    return ari, nmi


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-1, 3)), min_size=3, max_size=25))
def test_quality_equals_pair_counts(spark, pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    df = spark.createDataFrame(pairs, "t bigint, p bigint")
    got = quality.score_clusters(df, "t", "p").first()
    ari, nmi = pair_scores(a, b)
    assert got["ari"] == pytest.approx(ari, abs=1e-9) and got["nmi"] == pytest.approx(nmi, abs=1e-9)
    assert got["v_measure"] == pytest.approx(nmi, abs=1e-9)
    assert got["n_clusters"] == len({x for x in b if x != -1}) and got["noise_ratio"] == pytest.approx(b.count(-1) / len(b))
    assert quality.score_clusters(df, "p", "t").first()["ari"] == pytest.approx(ari, abs=1e-9)


def test_cluster_summary_order(spark):
    rows = [(c, f"t{i}", i) for i, c in enumerate([1, 1, 2, 2, 2, -1, -1, -1, -1, 2])]
    got = quality.cluster_summary(spark.createDataFrame(rows, "cluster bigint, title string, o int"), "cluster", order=["o"]).collect()
    assert [(r["cluster"], r["size"]) for r in got] == [(2, 4), (1, 2), (-1, 4)]
    assert got[0]["sample_titles"] == "t2 | t3 | t4"


@pytest.mark.parametrize("limit", [100, 0])
def test_best_match_both_ways(spark, limit):
    rng = np.random.default_rng(0)
    q, t = rng.normal(size=(40, 6)), rng.normal(size=(15, 6))
    qs = spark.createDataFrame([(i, i % 15, r.tolist()) for i, r in enumerate(q)], "qid bigint, own bigint, embedding array<double>")
    ts = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(t)], "label bigint, centroid array<double>")
    got = similarity.best_match(qs, ts, own="own", max_matrix_rows=limit).toPandas().sort_values("qid")
    sims = q @ t.T
    own = sims[np.arange(40), np.arange(40) % 15].copy()
    sims[np.arange(40), np.arange(40) % 15] = -np.inf
    assert got["match_id"].tolist() == sims.argmax(1).tolist()
    assert got["similarity"].to_numpy() == pytest.approx(sims.max(1)) and got["own_similarity"].to_numpy() == pytest.approx(own)


def test_scores_are_held_some_rows_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(6)
    q, t = rng.normal(size=(4_000, 8)), rng.normal(size=(4_000, 8))
    ids = np.arange(4_000)
    sims = q @ t.T
    own = sims[ids, ids].copy()
    sims[ids, ids] = -np.inf
    tracemalloc.start()
    got = similarity._score(q, ids, t, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[0] == sims.argmax(axis=1)).all()
    assert np.allclose(got[1], sims.max(axis=1)) and np.allclose(got[2], own)
    assert peak < 40_000_000  # all products together are 128 MB
    assert np.isnan(similarity._score(q, None, t, ids)[2]).all()


def test_best_match_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 7)
    monkeypatch.setattr(similarity, "TARGET_BLOCK", 4)
    rng = np.random.default_rng(1)
    q, t = rng.normal(size=(50, 4)), rng.normal(size=(30, 4))
    qs = spark.createDataFrame([(i, i % 2, r.tolist()) for i, r in enumerate(q)], "qid bigint, g bigint, embedding array<double>")
    ts = spark.createDataFrame([(i, i % 2, r.tolist()) for i, r in enumerate(t)], "label bigint, g bigint, centroid array<double>")
    got = similarity.best_match(qs, ts, group="g", max_matrix_rows=0).toPandas().sort_values("qid")
    sims = np.where((np.arange(50)[:, None] % 2) == (np.arange(30)[None, :] % 2), q @ t.T, -np.inf)
    assert got["match_id"].tolist() == sims.argmax(1).tolist()


def test_silhouette_counts_singletons_as_zero(spark):
    x = np.eye(4)[[0, 0, 1, 1, 2]] + 0.1
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(int(l), r.tolist()) for l, r in zip([0, 0, 1, 1, 2], x)], "label bigint, embedding array<double>")
    got = similarity.silhouette(df).first()
    d = 1 - x @ x.T
    want = np.mean([1.0 if l < 2 else 0.0 for l in [0, 0, 1, 1, 2]])
    assert d.shape == (5, 5) and got["silhouette"] == pytest.approx(want) and got["n_scored"] == 5
    assert similarity.silhouette(df.filter("label = 0")).first()["silhouette"] is None


def background(spark, n=100):
    return spark.createDataFrame(
        [(f"b{i}", f"topic {i % 4} words", f"topic {i % 4} words", f"s{i % 4}", "p", hours(i * 48 / n)) for i in range(n)],
        "post_id string, title string, text string, source string, platform string, timestamp timestamp",
    )


def test_injected_posts_lie_in_their_windows(spark):
    corpus, truth = injection.inject_bursts(background(spark), 3, 15, 4.0, seed=3)
    assert truth.count() == 3 and corpus.filter("platform <> 'injected'").count() == 100
    pdf, tr = corpus.filter("platform = 'injected'").toPandas(), truth.toPandas().set_index("burst_id")
    assert len(pdf) == 45
    for r in pdf.itertuples():
        burst = tr.loc[int(r.post_id.split("_")[1])]
        assert burst["burst_start"] <= r.timestamp <= burst["burst_end"] and r.source == burst["topic_label"]
    for k, part in pdf.groupby(pdf["post_id"].str.split("_").str[1]):
        ordered = part.assign(i=part["post_id"].str.split("_").str[2].astype(int)).sort_values("i")
        assert ordered["timestamp"].is_monotonic_increasing
    again, _ = injection.inject_bursts(background(spark).repartition(5), 3, 15, 4.0, seed=3)
    assert again.exceptAll(corpus).count() == 0


def test_injection_checks_its_input(spark):
    with pytest.raises(ValueError):
        injection.burst_truth(background(spark), 7)
    with pytest.raises(ValueError):
        injection.burst_truth(background(spark).filter("post_id = 'b1'"), 2)


def test_offsets_follow_the_beta_distribution():
    q = injection.offset_quantiles(128)
    assert q[0] == 0.0 and q[-1] == 1.0 and all(a < b for a, b in zip(q, q[1:]))
    assert np.mean([(a + b) / 2 for a, b in zip(q, q[1:])]) == pytest.approx(1.5 / 5.5, abs=2e-3)


def scored(spark, assigned, flags):
    truth = spark.createDataFrame(
        [(0, "t0", hours(0), hours(4)), (1, "t1", hours(20), hours(24))],
        "burst_id int, topic_label string, burst_start timestamp, burst_end timestamp",
    )
    posts = spark.createDataFrame(assigned, "post_id string, cluster_id bigint")
    log = spark.createDataFrame(flags, "cluster_id bigint, timestamp timestamp")
    per_burst = bursts.detect_bursts(truth, bursts.burst_majority(posts), log)
    return per_burst.orderBy("burst_id").collect(), bursts.detection_summary(per_burst, log).first()


def test_burst_scoring(spark):
    posts = [("injected_0_0", 5), ("injected_0_1", 5), ("injected_0_2", 9), ("injected_1_0", 7), ("x", 5)]
    per, s = scored(spark, posts, [(5, hours(2)), (5, hours(1)), (7, hours(31)), (8, hours(3))])
    assert per[0]["majority_cluster"] == 5 and per[0]["purity"] == pytest.approx(2 / 3)
    assert per[0]["detected"] and per[0]["latency_seconds"] == 3600.0
    assert not per[1]["detected"] and per[1]["latency_seconds"] is None  # flagged after the grace period
    assert s["recall"] == 0.5 and s["precision"] == pytest.approx(1 / 3) and s["n_false_positive_clusters"] == 2
    assert s["f1"] == pytest.approx(2 * 0.5 / 3 / (0.5 + 1 / 3)) and s["median_latency_seconds"] == 3600.0


def test_two_bursts_in_one_cluster_count_once_for_precision(spark):
    posts = [("injected_0_0", 5), ("injected_1_0", 5)]
    per, s = scored(spark, posts, [(5, hours(1)), (5, hours(21)), (6, hours(1))])
    assert [r["detected"] for r in per] == [True, True]
    assert s["precision"] == 0.5 and s["recall"] == 1.0


def test_nothing_flagged(spark):
    per, s = scored(spark, [("injected_0_0", 5)], [])
    assert s["precision"] == 0.0 and s["f1"] == 0.0 and s["median_latency_seconds"] is None and s["n_bursts"] == 2
    assert per[1]["majority_cluster"] is None and per[1]["purity"] == 0.0


def test_surging_rule(spark):
    rows = [(1, 10, True, math.inf), (2, 3, True, math.inf), (3, 20, False, 3.0), (4, 20, False, 1.5)]
    log = spark.createDataFrame(rows, "tracked_id bigint, size bigint, is_new boolean, growth_ratio double")
    got = {r["tracked_id"]: r["flagged"] for r in sliding.flag_surging(log).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_windows_are_open_on_the_left(spark):
    df = spark.createDataFrame([("a", hours(0)), ("b", hours(6)), ("c", hours(24)), ("d", hours(30))], "post_id string, timestamp timestamp")
    got = sliding.window_members(df, 24.0, 6.0).toPandas().groupby("refresh_no")["post_id"].apply(lambda s: "".join(sorted(s)))
    assert got.to_dict() == {0: "bc", 1: "cd", 2: "cd"}  # (0, 24], (6, 30], (12, 36]


def test_panes_equal_windows(spark):
    rng = np.random.default_rng(3)
    # a hot key with a third of the posts, gaps longer than a window, times on and beside the borders
    rows = [(f"p{i}", int(k), T0 + dt.timedelta(minutes=int(m))) for i, (k, m) in enumerate(zip(rng.integers(0, 6, 900) % 4, rng.integers(0, 240, 900) * 30))]
    rows += [("far", 9, hours(400)), ("far", 9, hours(400)), ("none", None, hours(50))]
    df = spark.createDataFrame(rows, "post_id string, tracked_id bigint, timestamp timestamp")
    for window, step in ((24.0, 6.0), (5.0, 3.0), (2.0, 6.0)):
        grid = sliding.RefreshGrid.of(df, window, step)
        counted = sliding.panes(df, grid, ["tracked_id"])
        got = {(r["tracked_id"], r["refresh_no"], r["refresh_ts"]): r["size"] for r in sliding.window_sizes(counted, grid, ["tracked_id"]).collect()}
        members = sliding.window_members(df, window, step)
        want = {(r["tracked_id"], r["refresh_no"], r["refresh_ts"]): r["count"] for r in members.groupBy("tracked_id", "refresh_no", "refresh_ts").count().collect()}
        assert got == want and len(want) > 20
        for least in (0, 5, 10_000):
            assert sliding.pane_cost(counted, grid, least).collect() == sliding.refresh_cost(members, least).collect()
    empty = df.limit(0)
    grid = sliding.RefreshGrid.of(empty)
    assert sliding.window_sizes(sliding.panes(empty, grid, ["tracked_id"]), grid, ["tracked_id"]).count() == 0


def test_labels(spark):
    rows = [
        (1, "a", "Chip shortage hits the chip industry"),
        (1, "b", "New chip shortage"),
        (2, "a", "the of and"),
        (3, "a", "  "),
        (3, "b", None),
    ]
    got = {r["cluster_id"]: r for r in labels.topic_labels(spark.createDataFrame(rows, "cluster_id bigint, post_id string, title string")).collect()}
    assert got[1]["label"].split(" / ")[0] in ("Chip", "Chip Shortage") and got[1]["description"].startswith('2 related posts, e.g. "Chip')
    assert got[2]["label"] == "the of and" and got[3]["label"] == "Unlabeled topic"
    assert got[3]["description"] == "No sample titles available."


def test_terms_equal_the_plain_definition(spark, monkeypatch):
    from collections import Counter, defaultdict

    rng = np.random.default_rng(4)
    named = [f"w{i}" for i in range(30)]
    rows = [(int(c), f"p{i}", " ".join(named[int(k)] for k in rng.integers(0, 6 if c == 1 else 30, int(rng.integers(0, 12))))) for i, c in enumerate(rng.integers(1, 4, 120))]
    rows += [(1, "p0", "w1 w1 w1"), (None, "q", "w1 w2"), (3, None, "w1 w2 w2"), (3, None, "w2 w2")]

    def plain(cap):
        docs, sizes = defaultdict(Counter), Counter()
        for c, doc, text in rows:
            words = text.split()
            if c is not None and words:
                sizes[c] += 1
                docs[c, doc].update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
        total, df = defaultdict(Counter), defaultdict(Counter)
        for (c, _), tf in docs.items():
            total[c].update(tf)
            df[c].update(tf.keys())
        out = defaultdict(float)
        for (c, _), tf in docs.items():
            kept = sorted(total[c], key=lambda t: (-total[c][t], t))[:cap]
            w = {t: tf[t] * (math.log((1 + sizes[c]) / (1 + df[c][t])) + 1) for t in kept if t in tf}
            for t in w:
                out[c, t] += w[t] / math.sqrt(sum(x * x for x in w.values()))
        return out

    counted = []
    real = labels._candidates
    monkeypatch.setattr(labels, "_candidates", lambda *a: counted.append(real(*a)) or counted[-1])
    df = spark.createDataFrame(rows, "cluster_id bigint, post_id string, title string")
    for cap in (3, 20, 50):
        got = {(r["cluster_id"], r["term"]): r["score"] for r in labels.term_scores(df, max_terms=cap).collect()}
        assert got == pytest.approx(dict(plain(cap)))
    # pairs of rare words are not counted
    assert counted[0].filter("cluster_id = 2").select("term").distinct().count() <= 5 + 5 * 5


def test_recent_titles_are_the_last_ones(spark):
    df = spark.createDataFrame([(1, f"p{i}", f"t{i}", hours(i)) for i in range(7)] + [(2, "q", "only", hours(0))], "cluster_id bigint, post_id string, title string, timestamp timestamp")
    got = {r["cluster_id"]: r for r in labels.member_summary(df).collect()}
    assert got[1]["sample_titles"] == "t2 | t3 | t4 | t5 | t6" and got[1]["member_count"] == 7
    assert got[2]["sample_titles"] == "only"


def topic_corpus(spark, topic_vector, seed=0):
    """Four background topics over 48 hours, and each burst topic with a vector of its own."""
    corpus, truth = injection.inject_bursts(background(spark), 3, 20, 4.0, seed=11)
    rows = corpus.select("post_id", "source").collect()
    names = sorted({r["source"] for r in rows})
    rng = np.random.default_rng(seed)
    vectors = []
    for r in sorted(rows, key=lambda r: r["post_id"]):
        v = topic_vector(names.index(r["source"])) + rng.normal(scale=0.02, size=32)
        vectors.append((r["post_id"], (v / np.linalg.norm(v)).tolist()))
    return corpus, spark.createDataFrame(vectors, "post_id string, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>")), truth


def test_online_benchmark_finds_bursts(spark, topic_vector):
    corpus, vectors, truth = topic_corpus(spark, topic_vector)
    per_burst, summary = evaluation.evaluate_online(corpus, vectors, truth, TrendParams(half_life_seconds=2 * 3600.0))
    s = summary.first()
    assert per_burst.count() == 3 and s["detection_rate"] >= 0.5 and s["n_bursts"] == 3


def test_sliding_benchmark(spark, topic_vector):
    corpus, vectors, truth = topic_corpus(spark, topic_vector)
    result = recluster_windows(corpus, vectors, 12.0, 4.0, min_cluster_size=3, min_samples=3, components=3)
    log = result.log.toPandas()
    assert set(log["is_new"]) == {True, False} and np.isinf(log.loc[log["is_new"], "growth_ratio"]).all()
    cost = result.cost.first()
    assert cost["n_refreshes"] > 0 and cost["total_posts_reclustered"] > 0
    _, summary = evaluate_sliding(corpus, vectors, truth, window_hours=12.0, refresh_hours=4.0, components=3)
    s = summary.first()
    assert s["n_bursts"] == 3 and s["n_refreshes"] == cost["n_refreshes"] and 0 <= s["precision"] <= 1


def test_static_clustering_of_topics(spark, topic_vector):
    corpus, vectors, _ = topic_corpus(spark, topic_vector)
    with pytest.raises(ValueError):
        cluster_corpus(corpus, "kmeans", vectors=vectors)
    result = cluster_corpus(corpus, "dbscan", vectors=vectors, components=5, eps=0.3)
    assert result.counts.first()["n_clusters"] >= 4
    joined = result.labels.withColumnRenamed("cluster", "cluster_id")
    assert quality.score_assignments(joined, corpus).first()["ari"] > 0.6


def test_sweep_table_and_best_row(spark):
    rows = [(0.5, 6.0, "text", -0.2, 0.4), (0.6, 6.0, "text", 0.3, 0.5), (0.55, 6.0, "text", 0.3, 0.5)]
    table = evaluation.sweep_table(spark.createDataFrame(rows, "similarity_threshold double, half_life_hours double, text_mode string, ari double, burst_f1 double"))
    assert [r["combined_score"] for r in table.collect()] == pytest.approx([0.4, 0.4, 0.2])
    assert report.best_row(table).first()["similarity_threshold"] == 0.55
    with pytest.raises(ValueError):
        report.best_row(table.limit(0))


def test_report_is_long(spark):
    one = spark.createDataFrame([(0.5, 3, "x")], "ari double, n bigint, note string")
    got = {(r["section"], r["metric"]): r["value"] for r in report.evaluation_report({"static": one, "dynamic": one}).collect()}
    assert got == {("static", "ari"): 0.5, ("static", "n"): 3.0, ("dynamic", "ari"): 0.5, ("dynamic", "n"): 3.0}


def test_unit_keeps_zero_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(scoring.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert BASE_US % 1_000_000 == 0 and isinstance(pd.Timestamp(T0), pd.Timestamp)


def test_static_scores_with_silhouette(spark):
    from tidewatch.plans import static

    rows = [("a", 1, "x", [1.0, 0.0]), ("b", 1, "x", [0.8, 0.6]), ("c", 2, "y", [0.0, 1.0]), ("d", -1, "y", [0.6, 0.8])]
    df = spark.createDataFrame(rows, "post_id string, cluster bigint, source string, embedding array<double>")
    got = static.score_static(df, df, df).first()
    # distances: a-b 0.2, a-c 1.0, b-c 0.4; c is alone and counts zero, d is noise
    assert got["silhouette"] == pytest.approx(((1.0 - 0.2) / 1.0 + (0.4 - 0.2) / 0.4 + 0) / 3)
    assert got["n_scored"] == 3 and got["n_posts"] == 4 and got["noise_ratio"] == 0.25 and got["homogeneity"] == pytest.approx(1.0)
    one = static.score_static(df.filter("cluster = 1"), df, df).first()
    assert one["silhouette"] is None and one["n_scored"] == 2
