"""Clustering jobs on vectors made from the tables, and parameter sweeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tidewatch.operators import density, embedding, injection, online, quality
from tidewatch.plans import evaluation, replay, report, sliding, static
from tidewatch.queries.quality import scores_sql
from tidewatch.queries.registry import SQL_USER_POSTS, doc_posts, query, rounded, table, user_posts
from tidewatch.queries.streams import _as_stream, _run
from tidewatch.runtime import materialize, spread
from tidewatch.schema import TrendParams
from tidewatch.streaming import online as stream_online

P = TrendParams()


def _blurred_signs(batches):
    """``post_id, timestamp``, and the vector made of the hex digits of the hashes of user and post; null where one is."""
    nibble = np.where(np.arange(16)[:, None] >> np.arange(4) & 1, 1 / 16, -1 / 16).astype(np.float32)
    for batch in batches:
        known = pc.and_(batch.column(2).is_valid(), batch.column(3).is_valid())
        u, p = (np.frombuffer("".join(batch.column(k).filter(known).to_pylist()).encode(), np.uint8).reshape(-1, 64) for k in (2, 3))
        digits = (u & 15) + 9 * (u >> 6)
        digits = np.where(p == ord("0"), digits ^ 3, digits)
        ends = pa.array(np.append(0, np.cumsum(known.to_numpy(zero_copy_only=False) * 256)), pa.int32())
        vectors = pa.ListArray.from_arrays(ends, pa.array(nibble[digits].ravel()), mask=pc.invert(known))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], vectors], names=["post_id", "timestamp", "embedding"])


def topic_vectors(spark, sf, blurred=False):
    """Posts of each user carry one unit vector, far from all others: 256 signs from a hash of the user.

    Blurred ones have two of the four signs turned at about every sixteenth digit, by a hash of the post: any two posts of a user
    have a cosine of about 0.88, and nearly every post has a vector of its own.
    """
    hexed = lambda c: F.filter(F.split(F.sha2(c.cast("string"), 256), ""), lambda d: d != "")
    nibble = F.array(*[F.array(*[F.lit(1 / 16 if n >> b & 1 else -1 / 16) for b in range(4)]) for n in range(16)])
    number = lambda d: F.instr(F.lit("0123456789abcdef"), d)
    users = spread(user_posts(spark, sf))
    if blurred:
        spelled = [F.sha2(F.col(c).cast("string"), 256) for c in ("cluster_id", "post_id")]
        return users.select("post_id", "timestamp", *spelled).toDF("post_id", "timestamp", "u", "p").mapInArrow(
            _blurred_signs, "post_id string, timestamp timestamp, embedding array<float>"
        )
    signs = F.flatten(F.transform(hexed(F.col("cluster_id")), lambda c: F.element_at(nibble, number(c))))
    vectors = users.select("cluster_id").distinct().select("cluster_id", signs.cast("array<float>").alias("embedding"))
    return users.join(vectors, "cluster_id").select("post_id", "timestamp", "embedding")


SQL_LIVES = f"""seq AS (SELECT post_id, cluster_id AS u, epoch_us(ts) AS us, row_number() OVER (PARTITION BY cluster_id ORDER BY ts) AS rn
    FROM user_posts),
  lives(u, rn, us, w, founder, post_id) AS (SELECT u, rn, us, 1.0::DOUBLE, post_id, post_id FROM seq WHERE rn = 1
    UNION ALL SELECT u, rn, us, CASE WHEN held < 0.05 THEN 1.0 ELSE held + 1 END, CASE WHEN held < 0.05 THEN post_id ELSE founder END, post_id
    FROM (SELECT s.u, s.rn, s.us, l.w * power(2.0, -(s.us - l.us) / {P.half_life_micros}::DOUBLE) AS held, l.founder, s.post_id
      FROM lives l JOIN seq s ON s.u = l.u AND s.rn = l.rn + 1))"""
SQL_FOUNDERS = f"WITH RECURSIVE {SQL_USER_POSTS}, {SQL_LIVES} SELECT post_id, founder FROM lives"


def _founders(assigned):
    first = assigned.groupBy("cluster_id").agg(F.min_by("post_id", "timestamp").alias("founder"))
    return assigned.join(first, "cluster_id").select("post_id", "founder")


@query("online_clusters", SQL_FOUNDERS)
def online_clusters(spark, sf):
    """Far apart topics, so that the clusters are known: a user's posts until the topic dies."""
    return _founders(materialize(online.online_clusters(topic_vectors(spark, sf), P), "assigned"))


@query("stream_online_clusters", SQL_FOUNDERS)
def stream_online_clusters(spark, sf):
    # vectors spelled out as JSON are twice their size in memory; as Parquet they may be one small file, so they are dealt to all cores
    posts = topic_vectors(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    return _founders(_run(stream_online.cluster_stream(_as_stream(posts, "vectors", "parquet"), P, cell_bits=3), "assigned"))


@query("online_clusters_in_chunks", SQL_FOUNDERS)
def online_clusters_in_chunks(spark, sf):
    """The same posts in coarser cells: the cells' width doesn't change the clusters of far apart topics."""
    return _founders(materialize(online.online_clusters(topic_vectors(spark, sf), P, bits=12, coarse_bits=4), "assigned"))


@query("online_clusters_blurred", SQL_FOUNDERS)
def online_clusters_blurred(spark, sf):
    """Posts that differ within their topic: hardly two share a cell, and topics still don't mix."""
    return _founders(materialize(online.online_clusters(topic_vectors(spark, sf, blurred=True), P), "assigned"))


@query("online_clusters_blurred_in_chunks", SQL_FOUNDERS)
def online_clusters_blurred_in_chunks(spark, sf):
    """Blurred posts in cells so wide that they hold several topics: impure sums are divided."""
    return _founders(materialize(online.online_clusters(topic_vectors(spark, sf, blurred=True), P, bits=6, coarse_bits=2), "assigned"))


def _doc_vectors(spark, sf):
    posts = materialize(doc_posts(spark, sf), "posts")
    return posts, materialize(embedding.embed_corpus(posts), "vectors")


@query("replay_assignments")
def replay_assignments(spark, sf):
    posts, vectors = _doc_vectors(spark, sf)
    return replay.replay(posts, P, vectors=vectors).assignments


@query("replay_summary")
def replay_summary(spark, sf):
    posts, vectors = _doc_vectors(spark, sf)
    return replay.replay(posts, P, vectors=vectors).summary


@query("replay_state_log")
def replay_state_log(spark, sf):
    posts, vectors = _doc_vectors(spark, sf)
    return replay.replay(posts, P, vectors=vectors).state_log


@query("principal_components")
def principal_components(spark, sf):
    _, vectors = _doc_vectors(spark, sf)
    return density.reduce_dimensions(vectors).select("post_id", "reduced")


def _plane(spark, sf):
    """Documents in a plane, from numbers of the tables: 1,000 lengths by the values of their events."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "events"), F.col("doc_id") == F.col("event_id"))
    return docs.select(
        F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("post_id"),
        F.array(F.log1p("value"), F.log1p("n_chars") / 4).alias("reduced"),
    )


PLANE_EPS, PLANE_MIN = 0.1, 5


def _dbscan_sql(near, least):
    """The plain definition over the neighbours ``nb`` (i, j) of the points ``pt``."""
    return f"""WITH RECURSIVE {near},
  co AS (SELECT i FROM nb GROUP BY i HAVING count(*) >= {least}),
  e AS (SELECT nb.i, nb.j FROM nb JOIN co a ON a.i = nb.i JOIN co b ON b.i = nb.j),
  walk(i, j) AS (SELECT i, i FROM co UNION SELECT w.i, e.j FROM walk w JOIN e ON e.i = w.j),
  comp AS (SELECT i, min(j) AS c FROM walk GROUP BY i),
  lab AS (SELECT i, c, true AS core FROM comp UNION ALL
    SELECT nb.i, min(c), false FROM nb JOIN comp ON comp.i = nb.j WHERE nb.i NOT IN (SELECT i FROM co) GROUP BY nb.i)
  SELECT 'doc_' || lpad(pt.i::VARCHAR, 9, '0') AS post_id, coalesce(core, false) AS core,
    coalesce('doc_' || lpad(c::VARCHAR, 9, '0'), 'noise') AS label FROM pt LEFT JOIN lab ON lab.i = pt.i"""


SQL_PLANE = f"""pt AS (SELECT doc_id AS i, ln(1 + value) AS x, ln(1 + n_chars) / 4 AS y FROM documents JOIN events ON doc_id = event_id),
  nb AS (SELECT a.i, b.i AS j FROM pt a JOIN pt b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {PLANE_EPS} * {PLANE_EPS})"""


@query("dbscan", _dbscan_sql(SQL_PLANE, PLANE_MIN))
def dbscan(spark, sf):
    found = density.density_clusters(density.as_points(_plane(spark, sf), 2, PLANE_EPS), 2, PLANE_MIN)
    return found.select(F.col("pid").alias("post_id"), "core", F.coalesce("label", F.lit("noise")).alias("label"))


def _digits(spark, sf, d):
    """Documents as points of ``d`` axes: near a place that the source decides, by hashes; every tenth one far out, every tenth half-way."""
    spelled = lambda *c: F.md5(F.concat(*c))
    digit = lambda text, i: F.instr(F.lit("0123456789abcdef"), F.substring(text, i + 1, 1)) / F.lit(15.0)
    docs = table(spark, sf, "documents").withColumn("wide", F.when(F.col("doc_id") % 10 == 0, 0.9).when(F.col("doc_id") % 10 == 1, 0.17).otherwise(0.12))
    docs = docs.withColumns({"home": spelled(F.lit("s"), "source"), "off": spelled(F.lit("d"), F.col("doc_id").cast("string"))})
    return docs.select(
        F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("post_id"),
        F.array(*[digit(F.col("home"), i) + digit(F.col("off"), i) * F.col("wide") for i in range(d)]).alias("reduced"),
    )


DIGITS_EPS, DIGITS_MIN = {5: 0.11037, 16: 0.27183}, 8


def _digits_sql(d):
    at = lambda text, i: f"instr('0123456789abcdef', substr({text}, {i + 1}, 1)) / 15.0::DOUBLE"
    axes = ", ".join(f"{at('home', i)} + {at('off', i)} * wide AS x{i}" for i in range(d))
    apart = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(d))
    return f"""pt AS (SELECT doc_id AS i, {axes} FROM (SELECT doc_id, md5('s' || source) AS home, md5('d' || doc_id) AS off,
      CASE doc_id % 10 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.17::DOUBLE ELSE 0.12::DOUBLE END AS wide FROM documents)),
  nb AS (SELECT a.i, b.i AS j FROM pt a JOIN pt b ON {apart} <= {DIGITS_EPS[d]!r}::DOUBLE * {DIGITS_EPS[d]!r}::DOUBLE)"""


def _dbscan_digits(spark, sf, d):
    found = density.density_clusters(density.as_points(_digits(spark, sf, d), d, DIGITS_EPS[d]), d, DIGITS_MIN)
    return found.select(F.col("pid").alias("post_id"), "core", F.coalesce("label", F.lit("noise")).alias("label"))


@query("dbscan_five", _dbscan_sql(_digits_sql(5), DIGITS_MIN))
def dbscan_five(spark, sf):
    return _dbscan_digits(spark, sf, 5)


@query("dbscan_sixteen", _dbscan_sql(_digits_sql(16), DIGITS_MIN))
def dbscan_sixteen(spark, sf):
    return _dbscan_digits(spark, sf, 16)


@query("density_levels")
def density_levels(spark, sf):
    plane = _plane(spark, sf)
    return density.density_levels(plane, density.level_scales(plane, 2), d=2)


@query("static_summary")
def static_summary(spark, sf):
    posts, vectors = _doc_vectors(spark, sf)
    return static.cluster_corpus(posts, "hdbscan", vectors=vectors, components=3).summary


@query("static_counts")
def static_counts(spark, sf):
    posts, vectors = _doc_vectors(spark, sf)
    return static.cluster_corpus(posts, "dbscan", vectors=vectors, components=3, eps=0.05).counts


def _burst_corpus(spark, sf):
    corpus, truth = injection.inject_bursts(doc_posts(spark, sf).drop("lang"), 6, 60)
    corpus = materialize(corpus, "corpus")
    return corpus, materialize(embedding.embed_corpus(corpus), "vectors"), truth


@query("online_burst_benchmark")
def online_burst_benchmark(spark, sf):
    corpus, vectors, truth = _burst_corpus(spark, sf)
    per_burst, _ = evaluation.evaluate_online(corpus, vectors, truth, P)
    return per_burst


@query("sliding_refresh_log")
def sliding_refresh_log(spark, sf):
    posts, vectors = _doc_vectors(spark, sf)
    return sliding.recluster_windows(posts, vectors, components=2).log


@query("sliding_burst_benchmark")
def sliding_burst_benchmark(spark, sf):
    corpus, vectors, truth = _burst_corpus(spark, sf)
    _, summary = sliding.evaluate_sliding(corpus, vectors, truth, components=2)
    return summary


@query("sweep_online")
def sweep_online(spark, sf):
    return evaluation.sweep_online(doc_posts(spark, sf).drop("lang"))


# Sweep tables on given scores: users stand in for similarity cells and event numbers for half-lives.
SQL_CELLS = f"""src AS (SELECT ([0.45, 0.55, 0.65, 0.75]::DOUBLE[])[user_id % 4 + 1] AS similarity_threshold,
    ([6.0, 24.0, 72.0]::DOUBLE[])[event_id % 3 + 1] AS half_life_hours, 'text' AS text_mode, event_type, user_id, value FROM events),
  {scores_sql('src', 'event_type', 'user_id', 'similarity_threshold, half_life_hours, text_mode, ')},
  f AS (SELECT similarity_threshold, half_life_hours, text_mode, round(avg(value) / 40, 6) AS burst_f1 FROM src GROUP BY ALL),
  sweep AS (SELECT similarity_threshold, half_life_hours, text_mode, ari, nmi, n_clusters, burst_f1,
    (greatest(ari, 0) + burst_f1) / 2 AS combined_score FROM scored JOIN f USING (similarity_threshold, half_life_hours, text_mode))"""


def _sweep(spark, sf):
    ev = table(spark, sf, "events")
    keys = ["similarity_threshold", "half_life_hours", "text_mode"]
    src = ev.select(
        F.element_at(F.array(*[F.lit(s) for s in evaluation.SIMILARITIES]), (F.col("user_id") % 4 + 1).cast("int")).alias(keys[0]),
        F.element_at(F.array(*[F.lit(h) for h in evaluation.HALF_LIFE_HOURS]), (F.col("event_id") % 3 + 1).cast("int")).alias(keys[1]),
        F.lit("text").alias(keys[2]),
        "event_type",
        "user_id",
        "value",
    )
    scored = rounded(quality.score_clusters(src, "event_type", "user_id", keys), "ari", "nmi")
    f1 = src.groupBy(*keys).agg(F.round(F.avg("value") / 40, 6).alias("burst_f1"))
    return evaluation.sweep_table(scored.join(f1, keys).select(*keys, "ari", "nmi", "n_clusters", "burst_f1"))


@query("sweep_scores", f"WITH {SQL_CELLS} SELECT * REPLACE (round(combined_score, 6) AS combined_score) FROM sweep")
def sweep_scores(spark, sf):
    return rounded(_sweep(spark, sf), "combined_score")


@query(
    "sweep_pivot",
    f"""WITH {SQL_CELLS} SELECT half_life_hours, round(avg(combined_score) FILTER (similarity_threshold = 0.45), 6) AS s45,
      round(avg(combined_score) FILTER (similarity_threshold = 0.55), 6) AS s55, round(avg(combined_score) FILTER (similarity_threshold = 0.65), 6) AS s65,
      round(avg(combined_score) FILTER (similarity_threshold = 0.75), 6) AS s75 FROM sweep GROUP BY half_life_hours""",
)
def sweep_pivot(spark, sf):
    table_ = evaluation.sweep_pivot(_sweep(spark, sf)).toDF("half_life_hours", "s45", "s55", "s65", "s75")
    return rounded(table_, "s45", "s55", "s65", "s75")


@query(
    "best_params",
    f"""WITH {SQL_CELLS} SELECT * REPLACE (round(combined_score, 6) AS combined_score) FROM sweep
    ORDER BY sweep.combined_score DESC, similarity_threshold, half_life_hours, text_mode LIMIT 1""",
)
def best_params(spark, sf):
    return rounded(report.best_row(_sweep(spark, sf)), "combined_score")
