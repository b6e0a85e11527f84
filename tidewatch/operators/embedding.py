"""Text to unit vectors, with a store that keeps vectors between runs."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.feature import IDF, HashingTF, IDFModel, NGram, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import text as tx
from tidewatch.runtime import has_files, materialize, spread

LOGGER = logging.getLogger(__name__)

VECTOR_DIM = 256


class Embedder(Protocol):
    """Anything that adds an ``embedding`` column (unit ``array<float>``) to a ``text`` column."""

    model_name: str

    def transform(self, df: DataFrame) -> DataFrame: ...


@dataclass
class HashingEmbedder:
    """Hashed one- and two-word counts, weighted by inverse document frequency, length one.

    Runs on the JVM. ``fit`` makes one pass that sums ``dim`` document counts and freezes them; the
    model name carries a digest of the fit, so stored vectors of different fits never mix.
    """

    dim: int = VECTOR_DIM
    idf: IDFModel | None = None

    @property
    def model_name(self) -> str:
        if self.idf is None:
            return f"hashing-tfidf-{self.dim}"
        rounded = np.round(self.idf.idf.toArray(), 9)
        return f"hashing-tfidf-{self.dim}-{hashlib.md5(rounded.tobytes()).hexdigest()[:8]}"

    def _counts(self, df: DataFrame, text: str) -> DataFrame:
        words = RegexTokenizer(
            inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False, toLowercase=True
        ).transform(df)
        pairs = NGram(n=2, inputCol="_words", outputCol="_pairs").transform(words)
        joined = pairs.withColumn("_terms", F.concat("_words", "_pairs"))
        return HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=self.dim).transform(joined)

    def fit(self, df: DataFrame, text: str = "text") -> "HashingEmbedder":
        return HashingEmbedder(self.dim, IDF(inputCol="_tf", outputCol="_idf").fit(self._counts(df, text)))

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        fitted = self if self.idf is not None else self.fit(df, text)
        weighted = fitted.idf.transform(self._counts(df, text))
        scaled = Normalizer(p=2.0, inputCol="_idf", outputCol="_unit").transform(weighted)
        return scaled.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
            "_words", "_pairs", "_terms", "_tf", "_idf", "_unit"
        )


@dataclass
class FunctionEmbedder:
    """A user's model: ``load`` runs once per task and returns texts -> matrix of unit rows."""

    model_name: str
    load: Callable[[], Callable[[list[str]], object]]

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
        load = self.load

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = load()
            for batch in batches:
                yield batch.assign(embedding=[[float(x) for x in row] for row in encode(batch[text].tolist())])

        return df.mapInPandas(run, schema)


def embedding_texts(posts: DataFrame, text_mode: str = "text") -> DataFrame:
    return posts.select("post_id", tx.embedding_text(text_mode, F.col("title"), F.col("text")).alias("text"))


def embed_corpus(posts: DataFrame, embedder: Embedder | None = None, text_mode: str = "text") -> DataFrame:
    """``post_id, embedding`` for every post."""
    embedder = embedder or HashingEmbedder()
    texts = spread(embedding_texts(posts, text_mode))
    return embedder.transform(texts).select("post_id", "embedding")


def missing_ids(posts: DataFrame, stored: DataFrame, id_column: str = "post_id") -> DataFrame:
    """Posts whose vector is not stored yet."""
    return posts.join(stored.select(id_column), id_column, "left_anti")


def read_store(posts: DataFrame, path: str, model_name: str, text_mode: str) -> DataFrame | None:
    """Stored vectors of one model and text mode, or None when there are none that can be read."""
    try:
        stored = posts.sparkSession.read.parquet(path)
    except PySparkException as error:
        LOGGER.warning("no readable vectors in %s: %s", path, type(error).__name__)
        return None
    needed = {"post_id", "embedding", "model_name", "text_mode"}
    if not needed <= set(stored.columns):
        return None
    chosen = stored.filter((F.col("model_name") == model_name) & (F.col("text_mode") == text_mode))
    return chosen.select("post_id", "embedding")


def write_store(vectors: DataFrame, path: str, model_name: str, text_mode: str) -> bool:
    """Appends the vectors whose ids the partition lacks; an unwritable store is reported, not fatal."""
    if has_files(vectors.sparkSession, path):
        known = read_store(vectors, path, model_name, text_mode)
        vectors = vectors if known is None else missing_ids(vectors, known)
    tagged = vectors.withColumns({"model_name": F.lit(model_name), "text_mode": F.lit(text_mode)})
    try:
        tagged.write.mode("append").partitionBy("model_name", "text_mode").parquet(path)
    except PySparkException as error:
        LOGGER.warning("vectors not stored in %s: %s", path, type(error).__name__)
        return False
    return True


def stored_fit(posts: DataFrame, path: str, embedder: HashingEmbedder, text_mode: str) -> HashingEmbedder:
    """The embedder with the weights kept beside the store; they are fitted and kept when there are none yet."""
    spark = posts.sparkSession
    kept = f"{path.rstrip('/')}/_fit-{embedder.dim}-{text_mode}"
    if has_files(spark, kept):
        return HashingEmbedder(embedder.dim, IDFModel.load(kept))
    fitted = embedder.fit(embedding_texts(posts, text_mode))
    try:
        fitted.idf.write().overwrite().save(kept)
    except (PySparkException, Py4JJavaError) as error:
        LOGGER.warning("weights not stored in %s: %s", kept, type(error).__name__)
    return fitted


def embed_corpus_cached(
    posts: DataFrame, path: str, embedder: Embedder | None = None, text_mode: str = "text"
) -> DataFrame:
    """Like ``embed_corpus``, but only posts without a stored vector are embedded and then stored.

    Another model or text mode is another partition of the store, so vectors never mix. The default embedder's
    weights are fitted once and then kept with the store, so later posts get vectors of the same model.
    """
    embedder = embedder or HashingEmbedder()
    if isinstance(embedder, HashingEmbedder) and embedder.idf is None:
        embedder = stored_fit(posts, path, embedder, text_mode)
    stored = read_store(posts, path, embedder.model_name, text_mode)
    todo = posts if stored is None else missing_ids(posts, stored)
    fresh = materialize(embed_corpus(todo, embedder, text_mode), "vectors")
    if write_store(fresh, path, embedder.model_name, text_mode):
        known = read_store(posts, path, embedder.model_name, text_mode)
    else:
        known = fresh if stored is None else stored.unionByName(fresh)
    return posts.select("post_id").join(known, "post_id")
