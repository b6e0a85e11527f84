"""From raw documents to token ids: five stages, each by one operator of ``tidewatch.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; what it returns is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``. Null texts, empty tables, repeated
rows and other columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.llm import decontam, langid, neardup, pieces, quality
from tidewatch.llm.queries import PIECE_BPE, vocabulary
from tidewatch.runtime import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with an accepted score."""
    return langid.keep_accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; a row without an id stays."""
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept"))
    # rows of one id are copies of a document; the first by a hash of the row stays
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    named = docs.filter("doc_id is not null").withColumn("_turn", F.row_number().over(once)).filter("_turn = 1").drop("_turn")
    return named.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, with its other columns and the number of ids."""
    return pieces.encode(docs, vocabulary(PIECE_BPE)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece_ids),
]

# Learned models, sketches and token ids can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
