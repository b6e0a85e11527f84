"""Posts made of documents, with and without an event of their number."""

import datetime as dt

import duckdb

from tidewatch.queries.registry import SQL_DOC_POSTS, doc_posts, posts


def test_documents_without_an_event_stay(spark, tmp_path):
    docs = [(k, f"text {k}", "en", "s") for k in range(6)]
    events = [(k, dt.datetime(2026, 1, 1, k), 10 + k) for k in (0, 2, 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for name in ("documents", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"WITH {SQL_DOC_POSTS} SELECT post_id, platform, epoch_us(ts) FROM doc_posts").fetchall()
    got = doc_posts(spark, str(tmp_path)).selectExpr("post_id", "platform", "unix_micros(timestamp) us").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 6
    assert ("doc_1", "p1", 1_000_000) in want


def test_whole_texts_are_not_joined_for_titles(spark, tmp_path):
    """Where only titles are read, the join of documents and events gets no text."""
    docs = [(k, f"text {k} " + "long " * 40, "en", "s") for k in range(6)]
    events = [(k, dt.datetime(2026, 1, 1, k), 10 + k, "view") for k in range(9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    for made, n in ((posts, 9), (doc_posts, 6)):
        titled = made(spark, str(tmp_path)).select("post_id", "title")
        above = titled._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
        assert "substring" not in above
        assert sorted(r["title"] for r in titled.collect()) == sorted(docs[k % 6][1][:80] for k in range(n))
