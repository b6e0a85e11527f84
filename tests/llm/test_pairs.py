"""Near copies, benchmark passages and the pipeline against brute force on small tables."""

import random

import duckdb
import pytest

from tidewatch.llm import decontam, neardup, quality

VOCABULARY = [f"w{k}" for k in range(400)]


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """Smallest id reachable over links of at least 0.75, by comparing all pairs."""
    sets = {i: sets_of(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def near_rows(seed=4):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(12):
        base = rng.choices(VOCABULARY, k=rng.choice([3, 8, 40, 150]))
        for edits in (0, 0, 1, 2, 3, 5, 9):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            rows.append((k, " ".join(words)))
            k += 1
    shared = " ".join(rng.choices(VOCABULARY, k=60))
    rows += [(k + i, shared + " " + " ".join(rng.choices(VOCABULARY, k=25))) for i in range(12)]
    return [*rows, (900, None), (901, ""), (902, " \n "), (903, "One two"), (904, "one TWO"), (905, "é " * 30000)]


def test_components_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bands int, digest string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    expected = components(rows)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(sets_of(t)) for i, t in rows}
    assert all(r["kept"] == (i == expected[i]) for i, r in got.items())
    assert got[900]["n_shingles"] == 0 and got[904]["component_id"] == 903


def test_no_documents_no_components(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_fill_every_coordinate_and_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        x = rng.integers(0, 1 << 63, 4 * n).astype(np.uint64)
        a, b = neardup.sketch(np.unique(x[: 3 * n])), neardup.sketch(np.unique(x[n:]))
        assert len(a) == neardup.COORDINATES and abs((a == b).mean() - 0.5) < 0.25 if n > 2 else len(a) == neardup.COORDINATES
    both = np.unique(x)
    differ = np.bitwise_count((neardup.parities(both[:200]) ^ neardup.parities(both[50:250])).view(np.uint64)).sum()
    assert differ <= 100


def test_pairs_alone_find_every_planted_pair(spark, monkeypatch):
    """Without hubs, every pair of 69 common shingles of 91 must be met in the first band whose key it shares."""
    hubs = neardup._hub_pairs
    monkeypatch.setattr(neardup, "_hub_pairs", lambda open_, turn: hubs(open_.limit(0), turn))
    rows = [(2 * k + j, " ".join([*(f"p{k}w{i}" for i in range(73)), *(f"p{k}x{j}w{i}" for i in range(11))])) for k in range(3000) for j in range(2)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert [r["doc_id"] for r in got if r["component_id"] != r["doc_id"] // 2 * 2] == []


@pytest.mark.parametrize("bucket_rows", [2, 512])
def test_blocks_of_a_bucket_meet_as_the_bucket_does(spark, monkeypatch, bucket_rows):
    """Without hubs, groups of near copies in buckets that are dealt into many blocks."""
    hubs = neardup._hub_pairs
    monkeypatch.setattr(neardup, "_hub_pairs", lambda open_, turn: hubs(open_.limit(0), turn))
    monkeypatch.setattr(neardup, "BUCKET_ROWS", bucket_rows)
    rows = near_rows(9)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(rows)


def test_repeated_rows_cost_one_comparison(spark, monkeypatch):
    """Two near copies and one other text, each row thousands of times in many partitions: one pair of sets is compared."""
    base = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:59], "x"])), (3, " ".join(reversed(base)))]
    compare, seen = neardup._compare, []

    def counted(pairs, sets):
        seen.append((pairs.count(), sets.count()))
        return compare(pairs, sets)

    monkeypatch.setattr(neardup, "_compare", counted)
    docs = spark.createDataFrame(rows * 3000, "doc_id long, text string").repartition(7)
    got = neardup.near_duplicates(docs).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, True, 3000), (2, 1, False, 3000), (3, 3, True, 3000)}
    assert all(pairs <= 1 and sets <= 3 for pairs, sets in seen)


def words_of(text):
    import re

    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def brute_hits(text, items, window=10):
    w, hit, found = words_of(text), set(), set()
    for item, words in items:
        n = min(window, len(words))
        for s in range(len(words) - n + 1) if n else ():
            for k in range(len(w) - n + 1):
                if w[k : k + n] == words[s : s + n]:
                    hit |= set(range(k, k + n))
                    found.add(item)
    return len(w), len(hit), sorted(x for x in found if x is not None)


def brute_longest(text, items, window=10):
    """Words of the longest stretch shared with an item, of at least a window or a whole shorter item."""
    w, best = words_of(text), 0
    for _, words in items:
        for s in range(len(words)):
            for k in range(len(w)):
                n = 0
                while s + n < len(words) and k + n < len(w) and words[s + n] == w[k + n]:
                    n += 1
                if n >= min(window, len(words)):
                    best = max(best, n)
    return best


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_matches_equal_brute_force(spark, block_bytes):
    rng = random.Random(2)
    bench = [(str(k), " ".join(rng.choices(VOCABULARY[:40], k=n))) for k, n in enumerate((25, 14, 10, 4, 1, 12))]
    bench += [("null", None), ("none", "!!"), ("1", "w1 w2 w3 unseen")]
    bench += [(None, "a passage without a name of its item, which must be found like any other one"), (None, None)]
    rows = [(60, "before it stands a passage without a name of its item, which must be found like any; then more")]
    for k in range(30):
        words = rng.choices(VOCABULARY[:60], k=rng.choice([0, 5, 80]))
        source = rng.choice(bench[:6])[1].split()
        at = rng.randrange(max(1, len(source) - 10))
        rows.append((k, " ".join([*words, *source[at : at + rng.choice([10, 11, 18])], *words]).upper() if k % 2 else "; ".join(words)))
    rows += [(50, None), (51, ""), (51, "")]
    docs = spark.createDataFrame([(i, t, "s", "n") for i, t in rows], "doc_id long, text string, spans string, items string")
    benchmark = spark.createDataFrame(bench, "item_id string, text string")
    got = decontam.matches(docs, benchmark, shard_bytes=500, block_bytes=block_bytes).collect()
    items = [(i, words_of(t)) for i, t in bench]
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = brute_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], sum(s["last"] - s["first"] for s in r["spans"]), r["items"]) == (n, hit, found)
        assert r["longest"] == brute_longest(texts[r["doc_id"]], items)
    assert next(r["longest"] for r in got if r["doc_id"] == 60) == 14
    kept = decontam.clean(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in rows if not brute_hits(t, items)[1])


def test_without_a_benchmark_everything_is_clean(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.clean(docs, spark.createDataFrame([], "item_id string, text string")).count() == 1


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for k in range(24):
        words = rng.choices(["the", "and", "house", "river", "stone", "green", "walks", "under", "morning", "table", *VOCABULARY[:200]], k=80)
        rows.append([k, " ".join(words), "en", "s", 0])
    rows[3][1] = rows[2][1] + " more"
    rows[5][1] = "short"
    rows[7][1] = " ".join(["same words again"] * 60)
    passage = " ".join(rows[11][1].split()[10:25])
    rows[20][1] = None
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    good = {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({quality.SQL})").fetchall() if kept}
    texts = {r[0]: r[1] for r in rows if r[0] in good}
    comps = components(list(texts.items()))
    items = [("1", words_of(passage))]
    expected = {i for i in texts if comps[i] == i and not brute_hits(texts[i], items)[1]}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == expected and 11 not in expected and 3 not in expected and 5 not in expected
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(list(r["ids"]) == library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in out)
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, str(tmp_path)).count() == 0, name
