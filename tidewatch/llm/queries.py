"""One registered query per operator of this folder, over whole tables, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat, decontam, langid, licences, lm, maintext, neardup, pieces, quality, runs, sharding, tokencount, variants

# Public vocabulary files; their folder is a parameter.
WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_minhash_neardup")
def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_benchmark_decontamination")
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives its text (a visible space reads as a space)."""
    plain = F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(plain, 256).alias("digest"))
    return pieces.encode_and_decode(docs, vocabulary(PIECE_BPE)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.char_length("text").cast("long").alias("decoded_chars"),
        (F.sha2("text", 256) == F.col("digest")).alias("round_trip"),
    )


@query("op7_quality_cascade", quality.SQL)
def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


@query("op4_chat_prefix_target", chat.SQL)
def op4_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = F.lit("</s>[INST] ok [/INST]")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.expand(turns.unionByName(planted)))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op1_license_scan", licences.SQL)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(licences.scan(table(spark, sf_dir, "documents")))


@query("op9_html_main_text")
def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants", variants.SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_virtual_slot_shards", sharding.SQL)
def op12_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.find_runs(table(spark, sf_dir, "documents"), rewrite=runs.planted))
