"""Vectors: lengths, products, centroids, best matches, silhouette, stored embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scoring
from tidewatch.operators import embedding, similarity
from tidewatch.queries.registry import SQL_DOC_POSTS, doc_posts, query, rounded, table
from tidewatch.runtime import scratch_path


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))


SQL_DIMS = "dims AS (SELECT vec_id, label::BIGINT AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"
SQL_MEANS = f"""{SQL_DIMS}, m0 AS (SELECT label, i, avg(x) AS x FROM dims GROUP BY ALL),
  m1 AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m0)"""


@query(
    "unit_vectors",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE) ** 2))), 6) AS norm,
      round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE) ** 2))), 6) AS unit_sum
    FROM embeddings""",
)
def unit_vectors(spark, sf):
    v = _vectors(spark, sf)
    unit = scoring.unit(F.transform("embedding", lambda x: x * 2))
    total = F.aggregate(unit, F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(scoring.cosine(F.col("embedding"), F.col("embedding")))
    return rounded(v.select("vec_id", norm.alias("norm"), total.alias("unit_sum")), "norm", "unit_sum")


@query(
    "centroids",
    f"""WITH {SQL_MEANS} SELECT m1.label, n AS size, round(sum(x), 6) AS total, round(max(x), 6) AS top
    FROM m1 JOIN (SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY 1) c ON c.label = m1.label GROUP BY ALL""",
)
def centroids(spark, sf):
    found = similarity.centroids(_vectors(spark, sf))
    total = F.aggregate("centroid", F.lit(0.0), lambda acc, x: acc + x)
    return rounded(found.select("label", "size", total.alias("total"), F.array_max("centroid").alias("top")), "total", "top")


@query(
    "nearest_centroid",
    f"""WITH {SQL_MEANS}, s AS (SELECT vec_id, m1.label AS match_id, sum(dims.x * m1.x) AS sim FROM dims JOIN m1 ON dims.i = m1.i GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, match_id) AS rn FROM s)
    SELECT vec_id, CASE WHEN sim >= 0.2 THEN match_id ELSE -1 END AS match_id, round(sim, 6) AS similarity FROM b WHERE rn = 1""",
)
def nearest_centroid(spark, sf):
    v = _vectors(spark, sf)
    found = similarity.best_match(v.select("vec_id", "embedding"), similarity.centroids(v), threshold=0.2)
    return rounded(found.select("vec_id", F.coalesce("match_id", F.lit(-1)).alias("match_id"), "similarity"), "similarity")


NEIGHBOR_SQL = """WITH p AS (SELECT a.vec_id, b.vec_id AS match_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, match_id) AS rn FROM p)
    SELECT vec_id, match_id, round(sim, 6) AS similarity FROM b WHERE rn = 1"""


@query("nearest_other_vector", NEIGHBOR_SQL)
def nearest_other_vector(spark, sf):
    """Every vector against all others, in blocks spread over the tasks."""
    v = _vectors(spark, sf).select("vec_id", "embedding")
    found = similarity.best_match(
        v, v, own="vec_id", target_id="vec_id", target_vector="embedding", max_matrix_rows=0
    )
    return rounded(found.select("vec_id", "match_id", "similarity"), "similarity")


@query(
    "consecutive_match",
    """WITH p AS (SELECT a.label::BIGINT AS step, a.vec_id, b.vec_id AS match_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
      FROM embeddings a JOIN embeddings b ON a.label = b.label + 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, match_id) AS rn FROM p)
    SELECT e.label::BIGINT AS step, e.vec_id, CASE WHEN sim >= 0.25 THEN match_id ELSE -1 END AS match_id, round(sim, 6) AS similarity
    FROM embeddings e LEFT JOIN b ON e.vec_id = b.vec_id AND rn = 1""",
)
def consecutive_match(spark, sf):
    v = _vectors(spark, sf).select(F.col("label").alias("step"), "vec_id", "embedding")
    found = similarity.consecutive_match(v, 0.25, step="step", cluster="vec_id", vector="embedding")
    return rounded(found.select("step", "vec_id", F.coalesce("match_id", F.lit(-1)).alias("match_id"), "similarity"), "similarity")


@query(
    "silhouette",
    """WITH p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
        / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    m AS (SELECT vec_id, la, lb, avg(d) AS d FROM p GROUP BY ALL),
    s AS (SELECT vec_id, max(CASE WHEN la = lb THEN d END) AS a, min(CASE WHEN la <> lb THEN d END) AS b FROM m GROUP BY ALL)
    SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n_scored FROM s""",
)
def silhouette(spark, sf):
    return rounded(similarity.silhouette(_vectors(spark, sf)), "silhouette")


@query(
    "missing_embeddings",
    "SELECT 'doc_' || doc_id AS post_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
)
def missing_embeddings(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("post_id"))
    stored = _vectors(spark, sf).select(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("post_id"))
    return embedding.missing_ids(docs, stored)


@query(
    "embedded_corpus",
    f"WITH {SQL_DOC_POSTS} SELECT post_id, 256 AS dim, CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM doc_posts",
)
def embedded_corpus(spark, sf):
    """Every post gets one vector of length one; its values come from Spark's own hashing."""
    vectors = embedding.embed_corpus(doc_posts(spark, sf))
    norm = F.round(F.sqrt(scoring.cosine(F.col("embedding"), F.col("embedding"))), 4)
    return vectors.select("post_id", F.size("embedding").alias("dim"), norm.alias("norm"))


def _length_model():
    """A user's model: one of seven directions by the length of the text."""

    def encode(texts):
        return [[float(len(t or "") % 7 == k) for k in range(7)] for t in texts]

    return encode


@query(
    "own_embedder",
    f"WITH {SQL_DOC_POSTS} SELECT post_id, 7 AS dim, coalesce(length(text), 0) % 7 AS direction FROM doc_posts",
)
def own_embedder(spark, sf):
    """The corpus under another model than the built-in one."""
    vectors = embedding.embed_corpus(doc_posts(spark, sf), embedding.FunctionEmbedder("length", _length_model))
    direction = (F.array_position("embedding", F.lit(1.0).cast("float")) - 1).alias("direction")
    return vectors.select("post_id", F.size("embedding").alias("dim"), direction)


@query(
    "cached_embeddings",
    f"WITH {SQL_DOC_POSTS} SELECT post_id, true AS kept FROM doc_posts",
)
def cached_embeddings(spark, sf):
    """Embeds judged documents first, then all: stored vectors stay as they were."""
    posts = doc_posts(spark, sf)
    judged = table(spark, sf, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("post_id"))
    embedder = embedding.HashingEmbedder().fit(embedding.embedding_texts(posts))
    path = scratch_path(spark, "vectors")
    first = embedding.embed_corpus_cached(posts.join(judged, "post_id", "left_semi"), path, embedder)
    before = first.select("post_id", F.xxhash64("embedding").alias("h"))
    after = embedding.embed_corpus_cached(posts, path, embedder).select("post_id", F.xxhash64("embedding").alias("h2"))
    return after.join(before, "post_id", "left").select("post_id", F.coalesce(F.col("h") == F.col("h2"), F.lit(True)).alias("kept"))
