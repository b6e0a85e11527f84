"""Cluster quality, summaries and topic labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import labels, quality
from tidewatch.operators.stopwords import STOP_WORDS
from tidewatch.plans import board, report, static
from tidewatch.queries.registry import SQL_EVENT_POSTS, SQL_POSTS, SQL_USER_POSTS, event_posts, posts, query, rounded, table, user_posts
from tidewatch.queries.trend import MEMBERS, P, SUMMARY_COLUMNS, _summary
from tidewatch.queries.sqltrend import features_sql, history_sql, latest_sql

SCORES = ("ari", "nmi", "homogeneity", "completeness", "v_measure", "noise_ratio")


def _labelled(spark, sf):
    """Documents with a cluster column: source number, documents judged toxic as noise."""
    docs = table(spark, sf, "documents")
    judged = table(spark, sf, "labels").select("doc_id", "toxic")
    return docs.join(judged, "doc_id", "left").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("post_id"),
        "doc_id",
        "lang",
        "source",
        F.substring("text", 1, 80).alias("title"),
        "text",
        F.when(F.col("toxic") == 1, F.lit(-1)).otherwise(F.regexp_extract("source", r"(\d+)$", 1).cast("int")).cast("bigint").alias("cluster_id"),
    )


SQL_LABELLED = """labelled AS (SELECT 'doc_' || d.doc_id AS post_id, d.doc_id, lang, source, substr(text, 1, 80) AS title, text,
  CASE WHEN toxic = 1 THEN -1 ELSE CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) END AS cluster_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def scores_sql(source: str, true: str, pred: str, keys: str = "") -> str:
    """CTE ``scored``: quality scores per ``keys`` (a column list ending in a comma, or empty)."""
    on = " AND ".join(f"c.{k.strip()} = {{t}}.{k.strip()}" for k in keys.split(",") if k.strip()) or "true"
    group = keys.rstrip(", ")
    tail = f"GROUP BY {group}" if group else ""
    return f"""cells AS (SELECT {keys} {true} AS t, {pred} AS p, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL),
  c AS (SELECT {keys} sum(n) AS n, sum(n * (n - 1) / 2) AS s, -sum(n * ln(n)) AS j,
      sum(CASE WHEN p = -1 THEN n ELSE 0 END) AS noise FROM cells {tail}),
  r AS (SELECT {keys} sum(n * (n - 1) / 2) AS a, -sum(n * ln(n)) AS e FROM (SELECT {keys} t, sum(n) AS n FROM cells GROUP BY ALL) {tail}),
  k AS (SELECT {keys} sum(n * (n - 1) / 2) AS b, -sum(n * ln(n)) AS e, count(*) FILTER (p <> -1) AS n_clusters
      FROM (SELECT {keys} p, sum(n) AS n FROM cells GROUP BY ALL) {tail}),
  v AS (SELECT c.*, a, b, n_clusters, r.e / n + ln(n) AS ht, k.e / n + ln(n) AS hp, j / n + ln(n) AS hj
      FROM c JOIN r ON {on.format(t='r')} JOIN k ON {on.format(t='k')}),
  w AS (SELECT *, greatest(ht + hp - hj, 0) AS mi, n * (n - 1) / 2 AS tot FROM v),
  x AS (SELECT *, CASE WHEN ht > 1e-12 THEN mi / ht ELSE 1 END AS hom, CASE WHEN hp > 1e-12 THEN mi / hp ELSE 1 END AS com FROM w),
  scored AS (SELECT {keys} round(CASE WHEN s = a AND s = b THEN 1 ELSE (s - a * b / tot) / ((a + b) / 2 - a * b / tot) END, 6) AS ari,
      round(CASE WHEN ht <= 1e-12 AND hp <= 1e-12 THEN 1 ELSE mi / ((ht + hp) / 2) END, 6) AS nmi, round(hom, 6) AS homogeneity,
      round(com, 6) AS completeness, round(CASE WHEN hom + com > 0 THEN 2 * hom * com / (hom + com) ELSE 0 END, 6) AS v_measure,
      n_clusters, CAST(n AS BIGINT) AS n_posts, round(noise / n, 6) AS noise_ratio FROM x)"""


@query("contingency", f"WITH {SQL_LABELLED} SELECT lang AS true_label, cluster_id AS pred_label, count(*) AS n FROM labelled GROUP BY ALL")
def contingency(spark, sf):
    return quality.contingency(_labelled(spark, sf), "lang", "cluster_id")


@query("cluster_quality", f"WITH {SQL_LABELLED}, {scores_sql('labelled', 'lang', 'cluster_id')} SELECT * FROM scored")
def cluster_quality(spark, sf):
    return rounded(quality.score_clusters(_labelled(spark, sf), "lang", "cluster_id"), *SCORES)


@query(
    "score_assignments",
    f"""WITH {SQL_EVENT_POSTS}, asg AS (SELECT 'ev_' || event_id AS post_id, user_id AS cluster_id FROM events),
    j AS (SELECT * FROM asg JOIN event_posts USING (post_id)), {scores_sql('j', 'source', 'cluster_id')} SELECT * FROM scored""",
)
def score_assignments(spark, sf):
    scored = quality.score_assignments(user_posts(spark, sf), event_posts(spark, sf))
    return rounded(scored, *SCORES)


@query(
    "quality_of_equal_labels",
    f"""WITH {SQL_EVENT_POSTS}, j AS (SELECT source AS s1, CASE source WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3
      WHEN 'signup' THEN 4 ELSE 5 END AS s2 FROM event_posts), {scores_sql('j', 's1', 's2')} SELECT * FROM scored""",
)
def quality_of_equal_labels(spark, sf):
    coded = F.array_position(F.array(*[F.lit(s) for s in ("view", "click", "error", "signup")]), F.col("source"))
    df = event_posts(spark, sf).select("source", F.when(coded == 0, 5).otherwise(coded).alias("s2"))
    return rounded(quality.score_clusters(df, "source", "s2"), *SCORES)


@query(
    "per_platform_scores",
    f"""WITH {SQL_EVENT_POSTS}, asg AS (SELECT 'ev_' || event_id AS post_id, user_id AS c1, event_id // 100 AS c2 FROM events),
    u AS (SELECT post_id, c1 AS cluster_id, 'dynamic' AS method FROM asg UNION ALL SELECT post_id, c2, 'static' FROM asg),
    j AS (SELECT * FROM u JOIN event_posts USING (post_id)
      WHERE platform IN (SELECT platform FROM event_posts GROUP BY platform HAVING count(*) >= 10)),
    {scores_sql('j', 'source', 'cluster_id', 'platform, method, ')} SELECT * FROM scored""",
)
def per_platform_scores(spark, sf):
    ev = table(spark, sf, "events")
    pid = F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("post_id")
    dynamic = ev.select(pid, F.col("user_id").alias("cluster_id"))
    static = ev.select(pid, F.floor(F.col("event_id") / 100).cast("bigint").alias("cluster_id"))
    scored = quality.score_per_platform(event_posts(spark, sf), {"dynamic": dynamic, "static": static})
    return rounded(scored, *SCORES)


@query(
    "noise_ratio",
    f"""WITH {SQL_LABELLED} SELECT count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS n_clusters,
      round(avg(CASE WHEN cluster_id = -1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS noise_ratio FROM labelled""",
)
def noise_ratio(spark, sf):
    return rounded(quality.noise_and_count(_labelled(spark, sf), "cluster_id"), "noise_ratio")


@query(
    "size_histogram",
    """WITH s AS (SELECT user_id, count(*) AS size FROM events GROUP BY user_id),
    e AS (SELECT min(size) AS lo, max(size) AS hi, CASE WHEN max(size) > min(size) THEN (max(size) - min(size)) / 30.0::DOUBLE ELSE 1 END AS w FROM s),
    b AS (SELECT CAST(least(floor((size - lo) / w), 29) AS INTEGER) AS bin FROM s, e)
    SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, count(*) AS n_clusters
    FROM b, e GROUP BY ALL""",
)
def size_histogram(spark, sf):
    ev = table(spark, sf, "events").select("user_id")
    return rounded(quality.size_histogram(ev, "user_id"), "bin_start", "bin_end")


@query(
    "cluster_summary",
    f"""WITH {SQL_LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) AS rn FROM labelled)
    SELECT cluster_id, count(*) AS size, string_agg(title, ' | ' ORDER BY rn) FILTER (rn <= 3) AS sample_titles
    FROM r GROUP BY cluster_id""",
)
def cluster_summary(spark, sf):
    return quality.cluster_summary(_labelled(spark, sf), "cluster_id", order=["doc_id"])


def _quoted(words):
    return ", ".join("'" + w + "'" for w in words)


def terms_sql(source: str, title: str = "title") -> str:
    """CTEs up to ``term_score(cluster_id, term, score)`` from ``source(cluster_id, post_id, <title>)``."""
    return f"""tk AS (SELECT cluster_id, post_id, list_filter(regexp_extract_all(lower({title}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
      lambda w: w NOT IN ({_quoted(STOP_WORDS)})) AS words FROM {source} WHERE trim({title}, ' ' || chr(10)) <> ''),
  nd AS (SELECT cluster_id, count(*) AS n FROM tk GROUP BY cluster_id),
  bi AS (SELECT cluster_id, post_id, unnest(words) AS term FROM tk UNION ALL
    SELECT cluster_id, post_id, words[i] || ' ' || words[i + 1] FROM (
      SELECT cluster_id, post_id, words, unnest(generate_series(1, len(words) - 1)) AS i FROM tk)),
  tf AS (SELECT cluster_id, post_id, term, count(*) AS tf FROM bi GROUP BY ALL),
  voc AS (SELECT cluster_id, term, df FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY total DESC, term) AS rn
    FROM (SELECT cluster_id, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL)) WHERE rn <= 50),
  wt AS (SELECT cluster_id, post_id, term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w
    FROM tf JOIN voc USING (cluster_id, term) JOIN nd USING (cluster_id)),
  nw AS (SELECT cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id, post_id)) AS w FROM wt),
  term_score AS (SELECT cluster_id, term, sum(w) AS score FROM nw GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, term DESC) AS rank FROM term_score)"""


LABEL_SQL = """heads AS (SELECT cluster_id, count(*) FILTER (trim(title, ' ' || chr(10)) <> '') AS n,
    arg_min(title, post_id) FILTER (trim(title, ' ' || chr(10)) <> '') AS first_title FROM {source} GROUP BY cluster_id),
  lab AS (SELECT cluster_id, string_agg(cap, ' / ' ORDER BY rank) AS label FROM (
    SELECT cluster_id, rank, array_to_string(list_transform(string_split(term, ' '),
      lambda w: upper(w[1]) || lower(w[2:])), ' ') AS cap FROM best WHERE rank <= 3) GROUP BY cluster_id),
  topic AS (SELECT cluster_id, CASE WHEN n = 0 THEN 'Unlabeled topic' WHEN label IS NULL THEN substr(first_title, 1, 60) ELSE label END AS label,
    CASE WHEN n = 0 THEN 'No sample titles available.' ELSE n || ' related posts, e.g. "' || first_title || '"' END AS description
    FROM heads LEFT JOIN lab USING (cluster_id))"""


@query(
    "tfidf_terms",
    f"WITH {SQL_LABELLED}, {terms_sql('labelled', 'text')} SELECT cluster_id, term, round(score, 6) AS score FROM term_score",
)
def tfidf_terms(spark, sf):
    return rounded(labels.term_scores(_labelled(spark, sf), title="text"), "score")


@query(
    "top_terms",
    f"WITH {SQL_LABELLED}, {terms_sql('labelled', 'text')} SELECT cluster_id, term, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 3",
)
def top_terms(spark, sf):
    return labels.top_terms(labels.term_scores(_labelled(spark, sf), title="text")).select("cluster_id", "term", "rank")


@query(
    "topic_labels",
    f"""WITH {SQL_LABELLED}, titles AS (SELECT cluster_id, post_id, CASE WHEN cluster_id = 7 THEN ' ' WHEN cluster_id = 8 THEN 'the x' ELSE text END AS title
      FROM labelled), {terms_sql('titles')}, {LABEL_SQL.format(source='titles')} SELECT * FROM topic""",
)
def topic_labels(spark, sf):
    """One cluster gets blank titles and one gets stop words only, to reach both fallbacks."""
    blank = F.when(F.col("cluster_id") == 7, " ").when(F.col("cluster_id") == 8, "the x").otherwise(F.col("text"))
    return labels.topic_labels(_labelled(spark, sf).withColumn("title", blank))


@query(
    "trend_board",
    f"""WITH {SQL_POSTS}, {SQL_USER_POSTS}, {history_sql('user_posts', P)}, {features_sql(P)}, {latest_sql()}, {MEMBERS},
    live AS (SELECT cluster_id FROM latest),
    titles AS (SELECT cluster_id, post_id, title FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, post_id DESC) AS rn
      FROM posts JOIN live USING (cluster_id)) WHERE rn <= 8),
    {terms_sql('titles')}, {LABEL_SQL.format(source='titles')}
    SELECT {SUMMARY_COLUMNS}, member_count, sample_titles, coalesce(label, '') AS label, coalesce(description, '') AS description
    FROM latest JOIN members USING (cluster_id) LEFT JOIN topic USING (cluster_id)""",
)
def trend_board(spark, sf):
    return _summary(board.trend_board(posts(spark, sf), P))


@query(
    "board_own_labels",
    f"""WITH {SQL_POSTS}, {SQL_USER_POSTS}, {history_sql('user_posts', P)}, {features_sql(P)}, {latest_sql()}, {MEMBERS},
    titles AS (SELECT cluster_id, title FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ts DESC, post_id DESC) AS rn
      FROM posts SEMI JOIN latest USING (cluster_id)) WHERE rn <= 8),
    named AS (SELECT cluster_id, min(title) AS label, count(title) || ' titles' AS description FROM titles GROUP BY cluster_id)
    SELECT {SUMMARY_COLUMNS}, member_count, sample_titles, coalesce(label, '') AS label, coalesce(description, '') AS description
    FROM latest JOIN members USING (cluster_id) LEFT JOIN named USING (cluster_id)""",
)
def board_own_labels(spark, sf):
    """The trend board under another labeler: a cluster is called after its first title in alphabetical order."""

    def labeler(titles):
        count = F.concat(F.count("title").cast("string"), F.lit(" titles"))
        return titles.groupBy("cluster_id").agg(F.min("title").alias("label"), count.alias("description"))

    return _summary(board.trend_board(posts(spark, sf), P, labeler=labeler))


# Vectors clustered by the signs of their first three coordinates, those without a positive one as noise; labels are the true clusters.
SQL_CELLS = """placed AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, CASE WHEN cell = 0 THEN -1 ELSE cell END AS cell FROM (SELECT *,
    (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT + 4 * (embedding[3] > 0)::INT AS cell FROM embeddings))"""
SQL_CELL_SILHOUETTE = """pair AS (SELECT a.vec_id, a.cell AS la, b.cell AS lb, 1 - list_dot_product(a.e, b.e)
      / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS dist
    FROM placed a JOIN placed b ON a.vec_id <> b.vec_id AND a.cell <> -1 AND b.cell <> -1),
  near AS (SELECT vec_id, la, lb, avg(dist) AS dist FROM pair GROUP BY ALL),
  ab AS (SELECT vec_id, max(CASE WHEN la = lb THEN dist END) AS a, min(CASE WHEN la <> lb THEN dist END) AS b FROM near GROUP BY ALL),
  sil AS (SELECT avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette, count(*)::DOUBLE AS n_scored FROM ab)"""


@query(
    "full_report",
    f"""WITH {SQL_CELLS}, {SQL_CELL_SILHOUETTE},
    j AS (SELECT 'static' AS section, label::VARCHAR AS t0, cell AS p0 FROM placed UNION ALL SELECT 'dynamic', event_type, user_id FROM events),
    {scores_sql('j', 't0', 'p0', 'section, ')},
    wide AS (SELECT section, ari, nmi, homogeneity, completeness, v_measure, n_clusters::DOUBLE AS n_clusters, n_posts::DOUBLE AS n_posts, noise_ratio FROM scored),
    long AS (UNPIVOT wide ON ari, nmi, homogeneity, completeness, v_measure, n_clusters, n_posts, noise_ratio INTO NAME metric VALUE value)
    SELECT section, metric, round(value, 6) AS value FROM long UNION ALL SELECT 'static', 'silhouette', round(silhouette, 6) FROM sil
    UNION ALL SELECT 'static', 'n_scored', n_scored FROM sil""",
)
def full_report(spark, sf):
    """A static clustering, with its silhouette, and a dynamic one in one report."""
    signs = [F.when(F.col("embedding")[k] > 0, F.lit(2**k)).otherwise(F.lit(0)) for k in range(3)]
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("post_id"), "embedding", F.col("label").cast("string").alias("source"), (signs[0] + signs[1] + signs[2]).alias("cell"))
    labels_ = v.select("post_id", F.when(F.col("cell") == 0, -1).otherwise(F.col("cell")).cast("bigint").alias("cluster"))
    scored = static.score_static(labels_, v, v)
    moving = quality.score_assignments(user_posts(spark, sf), event_posts(spark, sf))
    return rounded(report.full_report(static=scored, dynamic=moving), "value")
