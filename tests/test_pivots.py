"""Pivot search against all pairs, sums of cells against plain sums, and roots of forests."""

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.operators import online, pivots
from tidewatch.operators.components import tree_roots
from tidewatch.schema import TrendParams


def topics(rng, n, n_topics, noise, dim=24):
    base = rng.normal(size=(n_topics, dim))
    x = base[rng.integers(0, n_topics, n)] + noise * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("threshold", [0.45, 0.55, 0.75, 0.95])
@pytest.mark.parametrize("noise", [0.0, 0.2, 3.0])
def test_products_hold_every_similar_pair(threshold, noise):
    rng = np.random.default_rng(8)
    y, x = topics(rng, 700, 30, noise), topics(rng, 300, 40, noise)
    cells = pivots.Cells(y)
    met = np.zeros((len(x), len(y)), int)
    for rows, part, scores in cells.products(x, pivots.reach_of(threshold)):
        met[np.ix_(rows, cells.order[part])] += 1
        assert np.allclose(scores, x[rows] @ y[cells.order[part]].T, atol=1e-8)
    assert met.max() <= 1
    assert met[x @ y.T >= threshold].all()
    if noise == 0.0 and threshold > 0.9:
        assert met.sum() < 0.5 * met.size


@pytest.mark.parametrize("n_pivots, block", [(1, 8192), (40, 16), (1024, 64)])
def test_followers_equal_all_pairs(spark, n_pivots, block):
    rng = np.random.default_rng(9)
    n, t = 400, 0.7
    x = topics(rng, n, 25, 0.25)
    at = np.sort(rng.integers(0, 60, n))
    alive = at + rng.integers(0, 20, n)
    rows = [("r", f"n{k:03d}", int(at[k]) * 10 + k % 3, int(at[k]), int(alive[k]), bytearray(x[k].tobytes())) for k in range(n)]
    df = spark.createDataFrame(rows, "run string, node string, us bigint, slice bigint, alive bigint, centroid binary")
    from pyspark.sql import functions as F

    got = {r["src"]: r["dst"] for r in pivots.most_similar_before(df, {"r": t}, F.lit(pivots.reach_of(t)), block, n_pivots).collect()}
    want = {}
    for k in range(n):
        c = np.round(x @ x[k], 9)
        fit = [j for j in range(n) if c[j] >= t and (rows[j][2], rows[j][1]) < (rows[k][2], rows[k][1]) and at[j] <= at[k] <= alive[j]]
        if fit:
            want[rows[k][1]] = rows[min(fit, key=lambda j: (-c[j], rows[j][2], rows[j][1]))][1]
    assert got == want


def test_packed_rows_come_back(spark):
    x = np.arange(12.0).reshape(4, 3)
    assert (pivots.unpacked(pivots.packed(x)) == x).all()
    assert (pivots.unpacked(pivots.packed(x).slice(1, 2)) == x[1:3]).all()


def test_two_topics_in_one_cell_are_divided(spark):
    """A cell of one bit holds posts of orthogonal topics; their sum is impure however many there are of each."""
    from test_online import groups, make_posts, plain_loop

    q = np.linalg.qr(np.random.default_rng(4).normal(size=(16, 16)))[0]
    x = np.concatenate([q[[0, 1, 2]], q[[0] * 9 + [1, 2]]])
    us = 1_767_225_600_000_000 + np.arange(len(x)) * 1_000_000
    p = TrendParams(half_life_seconds=3600.0)
    got = online.online_clusters(make_posts(spark, us, x), p, bits=1, coarse_bits=1).orderBy("post_id").toPandas()["cluster_id"].tolist()
    assert groups(got) == groups(plain_loop(us, x, p)) == [0, 1, 2, *[0] * 9, 1, 2]


def test_roots_of_a_forest(spark):
    parents = [(k, k - 1) for k in range(1, 50)] + [(100 + k, 100) for k in range(1, 30)] + [(200, 49), (301, 300)]
    got = {r["node"]: r["root"] for r in tree_roots(spark.createDataFrame(parents, "src bigint, dst bigint")).collect()}
    assert got == {a: 0 if a < 50 or a == 200 else 100 if a < 150 else 300 for a, _ in parents}
    assert tree_roots(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_whole_rows_come_back_in_as_few_bytes_as_they_need():
    x = np.array([[1.0, -32767.0, 0.0], [3.0, 32768.0, -1.0], [2.0**40, -1.0, 5.0], [0.0, 0.0, 0.0]])
    column = pivots.packed_whole(x)
    assert [len(v) for v in column.to_pylist()] == [7, 13, 25, 7]
    assert (pivots.unpacked(column) == x).all()
    assert (pivots.unpacked(column.slice(1, 2)) == x[1:3]).all()
    assert np.allclose(pivots.units(column.slice(0, 3)), x[:3] / np.linalg.norm(x[:3], axis=1, keepdims=True))


@pytest.mark.parametrize("member_pairs", [5, 1 << 20])
def test_copies_of_an_epoch_are_one_place(spark, monkeypatch, member_pairs):
    """Copies move and are multiplied once, and each still follows the one of them that the plain rule names."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    x = topics(rng, 160, 4, 0.0)
    at = np.sort(rng.integers(0, 30, len(x)))
    rows = [("r", f"n{k:03d}", int(at[k]) * 10 + k % 2, int(at[k]), int(at[k] + k % 7), bytearray(x[k].tobytes())) for k in range(len(x))]
    df = spark.createDataFrame(rows, "run string, node string, us bigint, slice bigint, alive bigint, centroid binary")
    assert pivots._places(df.withColumn("epoch", F.lit(0)), F.struct("us", "node", "slice", "alive")).count() == 4
    queries = pivots._places(df.withColumn("epoch", F.lit(0)), F.struct("us", "node", "slice", "alive")).toArrow()
    monkeypatch.setattr(pivots, "MEMBER_PAIRS", member_pairs)
    found = pivots._Targets(queries).best(queries.combine_chunks().to_batches()[0], 0.7)
    got = {src: dst for src, dst, _, _ in found}
    want = {}
    for k in range(len(x)):
        c = np.round(x @ x[k], 9)
        fit = [j for j in range(len(x)) if c[j] >= 0.7 and rows[j][2:0:-1] < rows[k][2:0:-1] and rows[j][3] <= at[k] <= rows[j][4]]
        if fit:
            want[rows[k][1]] = rows[min(fit, key=lambda j: (-c[j], rows[j][2], rows[j][1]))][1]
    assert got == want


def test_posts_with_vectors_are_not_broadcast(spark, monkeypatch):
    """A table in a small file may be large in memory: doubtful sums meet their posts in a sorted join."""
    from test_online import make_posts

    plans, written = [], online.materialize

    def noted(df, name):
        if name == "impure":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(online, "materialize", noted)
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(16, 16)))[0]
    us = 1_767_225_600_000_000 + np.arange(6) * 1_000_000
    online.online_clusters(make_posts(spark, us, q[[0, 1, 2, 0, 1, 2]]), TrendParams(half_life_seconds=3600.0), bits=1, coarse_bits=1).count()
    assert plans and all("strategy=merge" in plan for plan in plans)


def test_a_query_goes_to_each_part_once(spark, monkeypatch):
    """Blocks of a part come one after another from files of the task, so places move once per part, not once per block."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    n, t, moved = 300, 0.6, []
    x = topics(rng, n, 40, 0.3)
    at = np.sort(rng.integers(0, 14, n))
    rows = [("r", f"n{k:03d}", int(at[k]) * 10 + k % 3, int(at[k]), int(at[k]) + 1, bytearray(x[k].tobytes())) for k in range(n)]
    df = spark.createDataFrame(rows, "run string, node string, us bigint, slice bigint, alive bigint, centroid binary")
    plain = type(df).repartition

    def counted(self, *args):
        if "part" in args:
            moved.append(self.count())
        return plain(self, *args)

    monkeypatch.setattr(type(df), "repartition", counted)
    monkeypatch.setattr(pivots, "PARTS", 0.01)  # one part
    got = {r["src"]: r["dst"] for r in pivots.most_similar_before(df, {"r": t}, F.lit(pivots.reach_of(t)), 16, 8).collect()}
    assert moved == [2 * n]  # each as a target and as a query; 19 blocks before, and most queries in most of them
    want = {}
    for k in range(n):
        c = np.round(x @ x[k], 9)
        fit = [j for j in range(n) if c[j] >= t and (rows[j][2], rows[j][1]) < (rows[k][2], rows[k][1]) and at[j] <= at[k] <= rows[j][4]]
        if fit:
            want[rows[k][1]] = rows[min(fit, key=lambda j: (-c[j], rows[j][2], rows[j][1]))][1]
    assert got == want


def test_cells_meet_queries_in_bounded_memory():
    """Many narrow cells and many queries: neither their angles nor their products are held at once."""
    import tracemalloc

    y = topics(np.random.default_rng(3), 6000, 3000, 0.02, dim=32)
    cells = pivots.Cells(y)
    assert len(cells.starts) > 2000
    tracemalloc.start()
    found = sum(len(a) for a, _, _ in cells.close(y, pivots.reach_of(0.95), np.full(len(y), 0.95)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == int((np.round(y @ y.T, 9) >= 0.95).sum())
    assert peak < 45_000_000, peak


def blurred(rng, n, n_topics, dim=256):
    """Signs of topics, a few of them turned in each row."""
    base = rng.choice([-1.0, 1.0], size=(n_topics, dim))
    return base[rng.integers(0, n_topics, n)] * np.where(rng.random((n, dim)) < 1 / 32, -1.0, 1.0)


def places(x, us, slices, alive):
    members = [[{"us": int(u), "node": f"n{k:05d}", "slice": int(s), "alive": int(a)}] for k, (u, s, a) in enumerate(zip(us, slices, alive))]
    kind = pa.list_(pa.struct([("us", pa.int64()), ("node", pa.string()), ("slice", pa.int64()), ("alive", pa.int64())]))
    return pa.RecordBatch.from_arrays([pivots.packed_whole(x), pa.array(members, kind)], names=["centroid", "members"])


def test_blurred_topics_pass_over_one_another(monkeypatch):
    """Many topics of few posts, none the same: a query is multiplied with its own topic and hardly another, and finds what all pairs find."""
    rng = np.random.default_rng(12)
    n, t = 4000, 0.55
    x = blurred(rng, n, 500)
    at = np.sort(rng.integers(0, 16, n))
    us, alive, multiplied = at * 1000 + np.arange(n) % 7, at + 10, []
    fit, pairs = pivots.Cells._fit, pivots.Cells.close_pairs

    def noted_fit(self, queries, single, rows, part, least):
        multiplied.append(len(rows) * (part.stop - part.start))
        return fit(self, queries, single, rows, part, least)

    def noted_pairs(self, queries, single, rows, cells, least, may):
        multiplied.append(int((self.ends - self.starts)[cells].sum()))
        return pairs(self, queries, single, rows, cells, least, may)

    monkeypatch.setattr(pivots.Cells, "_fit", noted_fit)
    monkeypatch.setattr(pivots.Cells, "close_pairs", noted_pairs)
    part = pivots._Part(512, pivots.WINDOW)
    batch = places(x, us, at, alive)
    for query in (False, True):
        for first in range(0, n, 1500):
            part.add(batch.slice(first, 1500), query)
    best = {}
    for found in part.best(t):
        for src, dst, when, cosine in found:
            best[src] = min(best.get(src, (2,)), (-cosine, when, dst))
    part.close()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    names, want = [f"n{k:05d}" for k in range(n)], {}
    for k in range(n):
        ok = np.flatnonzero((scores[k] >= t) & ((us < us[k]) | ((us == us[k]) & (np.arange(n) < k))) & (at <= at[k]) & (at[k] <= alive))
        if len(ok):
            want[names[k]] = min((-scores[k][j], us[j], names[j]) for j in ok)
    assert best == want
    assert sum(multiplied) < 0.03 * n * n, sum(multiplied) / n / n


def test_chains_and_copies_in_one_group():
    """Groups may be wider than a cell and larger than a block; rows with the same codes are one, and a wide group is divided."""
    rng = np.random.default_rng(13)
    turn = np.linspace(0, np.pi, 300)
    x = np.zeros((300, 8))
    x[:, 0], x[:, 1] = np.cos(turn), np.sin(turn)
    groups = pivots.groups_of(pivots.sign_codes(x), x.astype(np.float32))
    numbers = pivots.cells_of(x, np.zeros(300, np.int64))
    assert len(set(groups.tolist())) < 20
    assert len(set(numbers.tolist())) > 1
    cells = pivots.Cells(x, numbers)
    assert cells.radius.max() <= np.radians(pivots.WIDE) + 1e-9
    copies = np.repeat(rng.normal(size=(3, 8)), 400, axis=0)
    groups = pivots.groups_of(pivots.sign_codes(copies), copies.astype(np.float32))
    assert len(set(groups.tolist())) <= 3
    blocks = pivots._blocks(groups, 100)
    assert np.bincount(blocks).max() <= 150 and set(blocks.tolist()) == set(range(blocks.max() + 1))


@pytest.mark.parametrize("kind, size", [(pa.float32(), 5), (pa.float64(), 8)])
def test_raw_rows_come_back(kind, size):
    """Vectors of posts move as binary values of their own width; nulls stay null."""
    column = pa.array([[0.1, 2.0], None, [3.0, -4.25]], pa.list_(kind))
    raw = pivots.packed_raw(column)
    raw.validate(full=True)
    assert raw.null_count == 1 and raw.to_pylist()[0][-1] == size
    assert (pivots.matrix(raw.drop_null()) == pivots.matrix(column.drop_null())).all()
    assert pivots.packed_raw(pa.array([None], pa.list_(kind))).to_pylist() == [None]
