"""The vector store, the master table and the readers' unions under repeated and failing runs."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewatch.operators import embedding
from tidewatch.sources import corpus, readers

POST = "post_id string, title string, text string, source string, platform string, timestamp timestamp"


def made_posts(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("p"), "id").alias("post_id"), F.lit("").alias("title"), F.concat(F.lit("words of post "), "id").alias("text"))
    return rows.withColumns({"source": F.lit("s"), "platform": F.lit("x"), "timestamp": F.timestamp_seconds(F.lit(0))})


def test_one_new_post_is_the_only_one_embedded(spark, tmp_path):
    path = str(tmp_path / "vectors")
    first = {r["post_id"]: list(r["embedding"]) for r in embedding.embed_corpus_cached(made_posts(spark, 19), path).collect()}
    after = {r["post_id"]: list(r["embedding"]) for r in embedding.embed_corpus_cached(made_posts(spark, 20), path).collect()}
    assert len(after) == 20 and {k: after[k] for k in first} == first
    stored = spark.read.parquet(path)
    assert stored.count() == 20 and stored.select("model_name").distinct().count() == 1
    assert embedding.embed_corpus_cached(made_posts(spark, 20), path).count() == 20
    assert spark.read.parquet(path).count() == 20


def test_vectors_written_twice_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "vectors")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [0.5])], "post_id string, embedding array<float>")
    assert embedding.write_store(vectors, path, "m", "text") and embedding.write_store(vectors, path, "m", "text")
    assert spark.read.parquet(path).count() == 2


def test_a_broken_master_is_an_error(spark, tmp_path):
    path = str(tmp_path / "master")
    spark.createDataFrame([("a",)], "other string").write.parquet(path)
    with pytest.raises(AnalysisException):
        corpus.write_master(made_posts(spark, 3), path)
    assert spark.read.parquet(path).count() == 1


def test_accepted_spellings_of_comment_columns(spark):
    raw = spark.createDataFrame([("t", "v", "c", "2023-01-01")], "`TOPIC` string, `Video Title` string, comment string, `Published date` string")
    assert readers.youtube_posts(raw).first()["text"] == "c"


def test_a_failed_source_says_why(spark, tmp_path):
    assert readers.read_source(spark, "mail", "x").problem == "no such reader"
    failed = readers.read_source(spark, "reddit", str(tmp_path / "none.tsv"))
    assert failed.posts is None and failed.problem
