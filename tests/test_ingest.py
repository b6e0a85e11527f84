"""Readers, cleaning, merging, bundles, stored vectors, timeline, fingerprints."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as tx
from tidewatch.operators import embedding, fingerprint, timeline
from tidewatch.schema import POST_COLUMNS
from tidewatch.sources import bundle, corpus, readers, submissions


def posts(spark, rows):
    cols = "post_id string, title string, text string, source string, platform string, ts string"
    return spark.createDataFrame(rows, cols).select(*POST_COLUMNS[:5], F.col("ts").cast("timestamp").alias("timestamp"))


def test_reddit_tsv(spark, tmp_path):
    (tmp_path / "main.tsv").write_text(
        "post_id\tcreate_utc\tpost_url\ttitle\n"
        'abc123\t1700000000\thttps://www.example.com/r/technology/comments/x/\tHello "world\n'
        "abc124\t1700000060\tnot a link\t   \n"
        "abc125\t1700000060\tnot a link\t other \n"
    )
    got = readers.read_reddit_tsv(spark, str(tmp_path / "main.tsv")).orderBy("post_id").collect()
    assert [r["post_id"] for r in got] == ["reddit_kaggle_abc123", "reddit_kaggle_abc125"]
    assert got[0]["source"] == "technology" and got[0]["title"] == 'Hello "world' and got[0]["platform"] == "reddit"
    assert got[1]["source"] == "unknown" and got[1]["text"] == "other"
    assert got[0]["timestamp"] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_twitter_csv(spark, tmp_path):
    long = "x" * 100
    (tmp_path / "t.csv").write_text(
        f'id,user,date,text\n42,u,2021-01-05 10:00:00,"a ""quoted"", text\nover two lines"\n43,u,never,late\n44,u,2021-01-05 11:00:00,{long}\n'
    )
    got = {r["post_id"]: r for r in readers.read_twitter_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert set(got) == {"twitter_42", "twitter_44"}
    assert got["twitter_42"]["text"] == 'a "quoted", text\nover two lines' and got["twitter_42"]["source"] == "covid_vaccine"
    assert len(got["twitter_44"]["title"]) == 80 and len(got["twitter_44"]["text"]) == 100


def test_youtube_columns_are_matched_loosely(spark, tmp_path):
    (tmp_path / "y.csv").write_text("TOPIC,Video Title,comment,published_date\ngaming,Big Game Review,nice,2023-03-01\n,T,other,2023-03-02\n")
    got = {r["text"]: r for r in readers.read_youtube_csv(spark, str(tmp_path / "y.csv")).collect()}
    assert got["nice"]["source"] == "gaming" and got["nice"]["title"] == "Big Game Review"
    assert got["other"]["source"] == "general" and got["nice"]["post_id"] != got["other"]["post_id"]


def test_missing_columns_fail_before_any_job(spark):
    with pytest.raises(ValueError, match="create_utc"):
        readers.reddit_posts(spark.createDataFrame([("a",)], "post_id string"))
    with pytest.raises(ValueError):
        readers.youtube_posts(spark.createDataFrame([("a",)], "Topic string"))


def test_bluesky_takes_the_earliest_rows(spark, tmp_path):
    (tmp_path / "b.json").write_text(
        '{"text":"two","created_at":"2024-01-02T00:00:00Z"}\n{"text":"one","created_at":"2024-01-01T00:00:00Z"}\n{"text":" ","created_at":"2023-01-01T00:00:00Z"}\n'
    )
    got = readers.read_bluesky_dump(spark, str(tmp_path / "b.json"), 2).collect()
    assert [r["text"] for r in got] == ["one"]


def test_failing_sources_are_left_out(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,date,text\n1,2021-01-05 10:00:00,hi\n")
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    paths = {"twitter": str(tmp_path / "t.csv"), "reddit": str(tmp_path / "bad.csv"), "youtube": "/no/such/file", "mail": "x"}
    assert readers.load_all_sources(spark, paths).count() == 1
    empty = readers.load_all_sources(spark, {"mail": "x"})
    assert empty.count() == 0 and empty.columns == POST_COLUMNS


def test_cleaning_and_merging(spark, tmp_path):
    first = posts(spark, [("a", "t", "old a", "s", "p", "2026-01-02"), ("b", "t", "b", "s", "p", "2026-01-03"), ("x", "t", " \n", "s", "p", "2026-01-01")])
    second = posts(spark, [("a", "t", "new a", "s", "p", "2026-01-01"), ("c", "t", "c", "s", "p", "2026-01-01"), ("c", "t", "c later", "s", "p", "2026-01-04")])
    path = str(tmp_path / "master")
    corpus.write_master(corpus.clean_corpus(first), path)
    corpus.write_master(second, path)
    corpus.write_master(second, path)
    got = {r["post_id"]: r["text"] for r in corpus.load_corpus(spark, path).collect()}
    assert got == {"a": "old a", "b": "b", "c": "c"}
    merged = corpus.merge_master(second, corpus.clean_corpus(first)).collect()
    assert {r["post_id"]: r["text"] for r in merged} == got
    assert corpus.dropped_rows(first, corpus.clean_corpus(first)) == 1


def test_master_survives_a_csv_round_trip(spark, tmp_path):
    df = posts(spark, [("a", 'say "hi"', "line one\nline two", "s", "p", "2026-01-02 03:04:05.678901")])
    corpus.write_posts_csv(df, str(tmp_path / "csv"))
    back = corpus.load_corpus_csv(spark, str(tmp_path / "csv")).collect()
    assert back[0]["text"] == "line one\nline two" and back[0]["title"] == 'say "hi"'
    assert back[0]["timestamp"] == dt.datetime(2026, 1, 2, 3, 4, 5, 678901)


def test_submissions(spark):
    raw = spark.createDataFrame(
        [("1", " a\r\n b ", "c\t\td", "tech", 1700000000.5), ("2", "", None, "tech", 1.0), ("3", None, "only body", "tech", 2.0)],
        "id string, title string, selftext string, subreddit string, created_utc double",
    )
    got = submissions.parse_submissions(raw).orderBy("post_id").collect()
    assert [(r["post_id"], r["title"], r["text"]) for r in got] == [("reddit_1", "a b", "a b c d"), ("reddit_3", "", "only body")]
    assert got[0]["timestamp"] == dt.datetime(2023, 11, 14, 22, 13, 20, 500000)


def test_white_space_follows_unicode(spark):
    df = spark.createDataFrame([("  a 　b \x85",)], "s string")
    assert df.select(tx.squeezed(F.col("s")), tx.stripped(F.col("s"))).first()[0] == "a b"
    assert df.select(tx.stripped(F.col("s"))).first()[0] == "a 　b"


def test_embedding_text_modes(spark):
    df = spark.createDataFrame([("Video title", "a comment"), ("same text", "same text"), ("", "x"), (None, None)], "title string, text string")
    got = [r[0] for r in df.select(tx.embedding_text("title_text", F.col("title"), F.col("text"))).collect()]
    assert got == ["Video title. a comment", "same text", "x", ""]
    with pytest.raises(ValueError):
        tx.embedding_text("body", F.col("title"), F.col("text"))


def counting_model(path):
    """A user's model that writes down which texts it saw."""

    def load():
        def encode(texts):
            with open(path, "a") as log:
                log.write("".join(f"{t}\n" for t in texts))
            return [[len(t) / 2.0, 0.5] for t in texts]

        return encode

    return load


def test_stored_vectors_are_reused(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "vectors")
    one = posts(spark, [("a", "ta", "first text", "s", "p", "2026-01-01")])
    two = one.unionByName(posts(spark, [("b", "tb", "second text", "s", "p", "2026-01-02")]))
    model = embedding.FunctionEmbedder("m1", counting_model(str(log)))
    assert embedding.embed_corpus_cached(one, store, model).count() == 1
    assert embedding.embed_corpus_cached(two, store, model).count() == 2
    assert sorted(log.read_text().split("\n")) == ["", "first text", "second text"]
    embedding.embed_corpus_cached(two, store, model, text_mode="title_text").count()
    assert len(log.read_text().split()) > 4
    other = embedding.FunctionEmbedder("m2", counting_model(str(log)))
    assert embedding.embed_corpus_cached(two, store, other).count() == 2
    assert log.read_text().count("first text") == 3


def test_hashing_embedder_gives_unit_vectors(spark):
    df = posts(spark, [("a", "", "red apple pie", "s", "p", "2026-01-01"), ("b", "", "red apple cake", "s", "p", "2026-01-01"), ("c", "", "deep blue sea", "s", "p", "2026-01-01")])
    rows = {r["post_id"]: np.array(r["embedding"]) for r in embedding.embed_corpus(df).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1.0, abs=1e-5) for v in rows.values())
    assert rows["a"] @ rows["b"] > rows["a"] @ rows["c"]


def test_bundle_round_trip(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    assert bundle.load_bundle(spark, folder) is None
    labels = spark.createDataFrame([("a", 1)], "post_id string, cluster bigint")
    bundle.save_bundle(spark, folder, {"corpus_fingerprint": "f1"}, static_labels=labels)
    bundle.save_bundle(spark, folder, {"corpus_fingerprint": "f1", "generated_at": "now"}, dynamic_summary=labels)
    back = bundle.load_bundle(spark, folder)
    assert back["static_labels"].count() == 1 and back["dynamic_summary"].count() == 1 and back["embeddings"] is None
    assert back["run_meta"]["generated_at"] == "now"
    assert bundle.bundle_is_fresh(back, "f1") and not bundle.bundle_is_fresh(back, "f2")
    with pytest.raises(ValueError):
        bundle.save_bundle(spark, folder, {}, odd_piece=labels)


def test_evaluation_tables(spark, tmp_path):
    full = spark.createDataFrame([(1, 0.5)], "burst_id int, purity double")
    written = bundle.save_evaluation_csvs(str(tmp_path), eval_bursts=full, sweep_results=full.limit(0), eval_per_platform=None)
    assert [w.rsplit("/", 1)[1] for w in written] == ["eval_bursts"]
    assert spark.read.csv(written[0], header=True).columns == ["burst_id", "purity"]


def test_fingerprint_ignores_order(spark):
    def mark(ids, fn=fingerprint.corpus_fingerprint):
        return fn(spark.createDataFrame([(i,) for i in ids], "post_id string")).first()["fingerprint"]

    assert mark("abc") == mark("cba") != mark("abd")
    assert mark("abc", fingerprint.exact_fingerprint) == mark("bca", fingerprint.exact_fingerprint)
    import hashlib

    assert mark("abc", fingerprint.exact_fingerprint) == hashlib.sha256(b"a\nb\nc").hexdigest()[:16]
    a = spark.createDataFrame([("x",)], "post_id string")
    b = spark.createDataFrame([("y",)], "post_id string")
    assert fingerprint.same_corpus(a, a).collect()[0]["same"] and not fingerprint.same_corpus(a, b).collect()[0]["same"]


def test_exact_fingerprint_of_many_ids(spark):
    import hashlib

    ids = [f"ev_{i}" for i in range(1_000_001)]
    got = fingerprint.exact_fingerprint(spark.range(len(ids)).select(F.concat(F.lit("ev_"), F.col("id").cast("string")).alias("post_id")).repartition(7)).collect()
    assert [tuple(r) for r in got] == [(len(ids), hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()[:16])]
    odd = spark.createDataFrame([("b",), (None,), ("",), ("b",), ("ä",)], "post_id string")
    assert tuple(fingerprint.exact_fingerprint(odd).first()) == (5, hashlib.sha256("\nb\nb\nä".encode()).hexdigest()[:16])
    none = hashlib.sha256(b"").hexdigest()[:16]
    assert tuple(fingerprint.exact_fingerprint(odd.filter("post_id is null")).first()) == (1, none)
    assert tuple(fingerprint.exact_fingerprint(odd.limit(0)).first()) == (0, none)


def plain_tree(ids, depth):
    """Digest tree by sorting: {(level, prefix): (ids, digest)}."""
    import hashlib
    from collections import Counter

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    level, out = {}, {}
    for h, n in sorted(Counter(sha(i) for i in ids if i is not None).items()):
        level.setdefault(h[:depth], []).append((n, f"{h}:{n}"))
    level = {p: (sum(n for n, _ in x), sha("\n".join(line for _, line in x))) for p, x in level.items()}
    for at in range(depth, -1, -1):
        out |= {(at, p): x for p, x in level.items()}
        up = {}
        for p in sorted(level):
            up.setdefault(p[: at - 1], []).append(level[p])
        level = {p: (sum(n for n, _ in x), sha("".join(d for _, d in x))) for p, x in up.items()}
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_digest_tree_equals_plain_version(spark, depth):
    ids = [*(f"p{i % 300}" for i in range(500)), *["hot"] * 250, None, "", "é"]
    df = spark.createDataFrame([(i,) for i in ids], "post_id string").repartition(5)
    got = {(r["level"], r["prefix"]): (r["n_ids"], r["digest"]) for r in fingerprint.digest_tree(df, depth=depth).collect()}
    assert got == plain_tree(ids, depth)


def test_digest_tree_tells_where_tables_differ(spark):
    import hashlib

    a = spark.createDataFrame([(f"p{i}",) for i in range(400)], "post_id string")
    b = spark.createDataFrame([(f"p{i}",) for i in range(399, 0, -1)] + [("p7",), ("new",)], "post_id string")
    prefixes = {hashlib.sha256(x.encode()).hexdigest()[:3] for x in ("p0", "p7", "new")}
    assert {r["prefix"] for r in fingerprint.differing_ranges(a, b, depth=3).collect()} == prefixes
    assert fingerprint.differing_ranges(a, a.orderBy("post_id")).count() == 0
    assert fingerprint.digest_tree(a.limit(0)).count() == 0
    assert [fingerprint.tree_depth(n) for n in (0, 1000, 1001, 16000, 16001)] == [0, 0, 1, 1, 2]


def test_timeline(spark):
    df = posts(
        spark,
        [("a", "", "", "", "p1", "2026-01-01"), ("b", "", "", "", "p1", "2026-01-03"), ("c", "", "", "", "p2", "2026-01-02"), ("d", "", "", "", "p3", "2026-01-02")],
    )
    assert {r["post_id"] for r in timeline.restrict_to_overlap(df).collect()} == {"c", "d"}
    apart = posts(spark, [("a", "", "", "", "p1", "2026-01-01"), ("b", "", "", "", "p2", "2026-02-01")])
    assert timeline.restrict_to_overlap(apart).count() == 0
    aligned = {r["post_id"]: r for r in timeline.align_timelines(df, 10.0).collect()}
    assert aligned["b"]["timestamp"] == dt.datetime(2026, 1, 11) and aligned["c"]["timestamp"] == dt.datetime(2026, 1, 1)
    assert aligned["b"]["timestamp_original"] == dt.datetime(2026, 1, 3) and aligned["b"]["timeline_mode"] == "aligned"
    assert pd.Timestamp(aligned["a"]["timestamp"]) == pd.Timestamp("2026-01-01")


def test_platform_filter_falls_back_to_all(spark):
    df = posts(spark, [("a", "", "", "", "p1", "2026-01-01"), ("b", "", "", "", "p2", "2026-01-03")])
    assert corpus.platform_or_all(df, "p1").count() == 1 and corpus.platform_or_all(df, "p9").count() == 2
    assert [r["post_id"] for r in corpus.most_recent(df, 1).collect()] == ["b"]
