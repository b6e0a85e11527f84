"""Bursts in the tables and how well flags find them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import scoring, times
from tidewatch.functions import text as tx
from tidewatch.operators import bursts, injection, sliding, trend, weights
from tidewatch.plans import report
from tidewatch.queries.registry import SQL_POSTS, SQL_USER_POSTS, iso_sql, posts, query, rounded, table
from tidewatch.queries.sqltrend import features_sql, history_sql, transitions_sql
from tidewatch.runtime import broadcast_if_small, materialize
from tidewatch.schema import TrendParams

P = TrendParams()
SEED, SPAN_H = 42, 6
HOUR = 3_600_000_000
SPAN = SPAN_H * HOUR


def uniform_sql(*parts: str) -> str:
    joined = " || '|' || ".join(parts)
    return f"(CAST('0x' || substr(md5({joined}), 1, 13) AS BIGINT) / {float(1 << 52)}::DOUBLE)"


# A burst is the busiest six hours of an event type; its posts are the events of that type and time.
SQL_TRUTH = f"""slots AS (SELECT event_type, epoch_us(ts) // {SPAN} AS slot, count(*) AS n, CAST(sum(epoch_us(ts) % {SPAN}) AS BIGINT) AS late
    FROM events GROUP BY ALL),
  busiest AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, slot) AS rn FROM slots),
  truth AS (SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS burst_id, event_type AS topic_label, make_timestamp(slot * {SPAN}) AS burst_start,
    make_timestamp(slot * {SPAN} + late // n) AS peak, make_timestamp(slot * {SPAN} + {SPAN}) AS burst_end, n AS n_posts FROM busiest WHERE rn = 1)"""
SQL_INJECTED = """injected AS (SELECT 'injected_' || burst_id || '_' || event_id AS post_id, event_type AS source, burst_id, ts, event_id
    FROM events JOIN truth ON event_type = topic_label AND ts >= burst_start AND ts < burst_end)"""


def _truth(spark, sf):
    """A row per event type, on the driver only while there are few."""
    ev = table(spark, sf, "events")
    us = times.micros(F.col("ts").cast("timestamp"))
    slots = ev.groupBy("event_type", times.floor_div(us, SPAN).alias("slot")).agg(F.count("*").alias("n"), F.sum(F.pmod(us, F.lit(SPAN))).alias("late"))
    busiest = slots.groupBy("event_type").agg(F.min(F.struct((-F.col("n")).alias("less"), "slot", "n", "late")).alias("b")).select("event_type", "b.*")
    start = F.col("slot") * SPAN
    truth = busiest.select(
        (F.row_number().over(Window.orderBy("event_type")) - 1).alias("burst_id"),
        F.col("event_type").alias("topic_label"),
        F.timestamp_micros(start).alias("burst_start"),
        F.timestamp_micros(start + times.floor_div(F.col("late"), F.col("n"))).alias("peak"),
        F.timestamp_micros(start + SPAN).alias("burst_end"),
        F.col("n").alias("n_posts"),
    )
    return broadcast_if_small(truth)


def _in_burst(truth):
    return (F.col("source") == truth["topic_label"]) & (F.col("timestamp") >= truth["burst_start"]) & (F.col("timestamp") < truth["burst_end"])


@query(
    "burst_truth",
    f"""WITH {SQL_TRUTH} SELECT burst_id, topic_label, {iso_sql('burst_start')} AS burst_start, {iso_sql('peak')} AS peak,
      {iso_sql('burst_end')} AS burst_end, n_posts FROM truth""",
)
def burst_truth(spark, sf):
    truth = _truth(spark, sf)
    return truth.withColumns({c: times.iso(F.col(c)) for c in ("burst_start", "peak", "burst_end")})


@query("burst_posts", f"WITH {SQL_TRUTH}, {SQL_INJECTED} SELECT post_id, source, {iso_sql('ts')} AS ts FROM injected")
def burst_posts(spark, sf):
    made = _placed(spark, sf, _truth(spark, sf)).filter("burst_id is not null")
    return made.select("post_id", "source", times.iso(F.col("timestamp")).alias("ts"))


def _case_sql(pools: dict[str, list[str]], word: str) -> str:
    arms = " ".join("WHEN '" + k + "' THEN [" + ", ".join("'" + w + "'" for w in v) + "]" for k, v in pools.items())
    return f"CASE lower(trim({word}, '.,!?')) {arms} END"


@query(
    "paraphrased_titles",
    f"""WITH w AS (SELECT post_id, words[i + 1] AS word, i, {_case_sql(injection.SYNONYMS, "words[i + 1]")} AS pool FROM (
      SELECT post_id, words, unnest(generate_series(0, len(words) - 1)) AS i FROM (
        SELECT 'doc_' || doc_id AS post_id, string_split(text, ' ') AS words FROM documents))),
    c AS (SELECT post_id, i, word, pool, {uniform_sql("'42'", "post_id", "i", "'swap'")} AS u,
      pool[CAST(floor({uniform_sql("'42'", "post_id", "i", "'pick'")} * len(pool)) AS INTEGER) + 1] AS chosen FROM w)
    SELECT post_id, md5(string_agg(CASE WHEN pool IS NULL OR u >= 0.5 THEN word
      WHEN word[1] = upper(word[1]) AND word[1] <> lower(word[1]) THEN upper(chosen[1]) || lower(chosen[2:]) ELSE chosen END, ' ' ORDER BY i)) AS text_md5
    FROM c GROUP BY post_id""",
)
def paraphrased_titles(spark, sf):
    """Whole texts of the documents with words swapped for their synonyms."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("post_id"), "text")
    return docs.select("post_id", F.md5(injection.paraphrase(F.col("text"), F.col("post_id"), SEED)).alias("text_md5"))


@query(
    "injected_corpus",
    f"""WITH {SQL_POSTS}, {SQL_TRUTH}, a AS (SELECT source, CASE WHEN burst_id IS NULL THEN platform ELSE 'injected' END AS platform, ts
      FROM posts LEFT JOIN truth ON source = topic_label AND ts >= burst_start AND ts < burst_end)
    SELECT platform, source, count(*) AS n_posts, {iso_sql('min(ts)')} AS first_ts, {iso_sql('max(ts)')} AS last_ts FROM a GROUP BY ALL""",
)
def injected_corpus(spark, sf):
    truth = _truth(spark, sf)
    corpus = posts(spark, sf)
    corpus = corpus.join(truth, _in_burst(truth), "left").withColumn("platform", F.when(F.col("burst_id").isNull(), F.col("platform")).otherwise(F.lit("injected")))
    grouped = corpus.groupBy("platform", "source").agg(
        F.count("*").alias("n_posts"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )
    return grouped.withColumns({c: times.iso(F.col(c)) for c in ("first_ts", "last_ts")})


# Assignments without vectors: events by user, those of a burst in a cluster of its own but for a
# fifth of them that stray into user clusters, and two bursts that share one cluster.
SQL_ASSIGNED = f"""assigned AS (SELECT * FROM user_posts WHERE post_id NOT IN (SELECT 'ev_' || event_id FROM injected) UNION ALL SELECT post_id,
    CASE WHEN {uniform_sql("'stray'", "post_id")} < 0.2 THEN 3 ELSE 1000000 + least(burst_id, 3) END AS cluster_id, ts FROM injected)"""


def _placed(spark, sf, truth):
    """Every event as a post, those of a burst under its name, in one pass."""
    ev = table(spark, sf, "events")
    named = ev.select("event_id", "user_id", F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("timestamp"))
    number = F.col("event_id").cast("string")
    post_id = F.when(F.col("burst_id").isNull(), F.concat(F.lit("ev_"), number)).otherwise(F.concat(F.lit("injected_"), F.col("burst_id").cast("string"), F.lit("_"), number))
    placed = named.join(truth.select("burst_id", "topic_label", "burst_start", "burst_end"), _in_burst(truth), "left").withColumn("post_id", post_id)
    stray = tx.hash_uniform(F.lit("stray"), F.col("post_id")) < 0.2
    cluster = F.when(F.col("burst_id").isNull(), F.col("user_id")).when(stray, F.lit(3)).otherwise(F.lit(1_000_000) + F.least("burst_id", F.lit(3)))
    return placed.select("post_id", cluster.cast("bigint").alias("cluster_id"), "timestamp", "source", "burst_id")


def _assigned(spark, sf):
    return _placed(spark, sf, _truth(spark, sf)).select("post_id", "cluster_id", "timestamp")


@query(
    "burst_majority",
    f"""WITH {SQL_USER_POSTS}, {SQL_TRUTH}, {SQL_INJECTED}, {SQL_ASSIGNED},
    c AS (SELECT CAST(regexp_extract(post_id, '^injected_([0-9]+)_', 1) AS INTEGER) AS burst_id, cluster_id, count(*) AS n FROM assigned
      WHERE post_id LIKE 'injected%' GROUP BY ALL)
    SELECT burst_id, cluster_id AS majority_cluster, round(n / total, 6) AS purity FROM (SELECT *, sum(n) OVER (PARTITION BY burst_id) AS total,
      row_number() OVER (PARTITION BY burst_id ORDER BY n DESC, cluster_id) AS rn FROM c) WHERE rn = 1""",
)
def burst_majority(spark, sf):
    return rounded(bursts.burst_majority(_assigned(spark, sf)), "purity")


SQL_DETECT = f"""WITH {SQL_USER_POSTS}, {SQL_TRUTH}, {SQL_INJECTED}, {SQL_ASSIGNED}, {history_sql('assigned', P)}, {features_sql(P)},
  {transitions_sql(P)}, flags AS (SELECT cluster_id, ts FROM trans WHERE state = 'trending'),
  mc AS (SELECT CAST(regexp_extract(post_id, '^injected_([0-9]+)_', 1) AS INTEGER) AS burst_id, cluster_id, count(*) AS n FROM assigned
    WHERE post_id LIKE 'injected%' GROUP BY ALL),
  maj AS (SELECT burst_id, cluster_id, n / total AS purity FROM (SELECT *, sum(n) OVER (PARTITION BY burst_id) AS total,
    row_number() OVER (PARTITION BY burst_id ORDER BY n DESC, cluster_id) AS rn FROM mc) WHERE rn = 1),
  hit AS (SELECT t.burst_id, min(flags.ts) AS first_flag FROM truth t JOIN maj ON t.burst_id = maj.burst_id JOIN flags
    ON flags.cluster_id = maj.cluster_id AND flags.ts BETWEEN t.burst_start AND t.burst_end + INTERVAL 6 HOUR GROUP BY 1),
  per_burst AS (SELECT t.burst_id, topic_label, burst_start, cluster_id AS majority_cluster, purity, first_flag IS NOT NULL AS detected,
    (epoch_us(first_flag) - epoch_us(burst_start)) / 1000000.0::DOUBLE AS latency_seconds
    FROM truth t JOIN maj ON t.burst_id = maj.burst_id LEFT JOIN hit ON t.burst_id = hit.burst_id)"""

SQL_DETECT_SUMMARY = """, matched AS (SELECT DISTINCT majority_cluster AS c FROM per_burst WHERE detected),
  fp AS (SELECT count(DISTINCT cluster_id) AS fp FROM flags WHERE cluster_id NOT IN (SELECT c FROM matched)),
  ds0 AS (SELECT count(*) AS n_bursts, count(*) FILTER (detected) AS nd, (SELECT count(*) FROM matched) AS tp, (SELECT fp FROM fp) AS fp,
    quantile_cont(latency_seconds, 0.5) AS med, quantile_cont(latency_seconds, 0.9) AS p90 FROM per_burst),
  ds1 AS (SELECT *, nd / n_bursts AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec FROM ds0),
  detection AS (SELECT recall AS detection_rate, med AS median_latency_seconds, p90 AS p90_latency_seconds, prec AS precision, recall,
    CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0 END AS f1, n_bursts, fp AS n_false_positive_clusters FROM ds1)"""

RATES = ("detection_rate", "median_latency_seconds", "p90_latency_seconds", "precision", "recall", "f1")
SQL_RATES = ", ".join(f"round({c}, 6) AS {c}" for c in RATES)


def _flags(assigned):
    log = trend.state_transitions(weights.weight_history(assigned, P), P)
    return log.filter(F.col("state") == "trending").select("cluster_id", "timestamp")


def _detected(spark, sf):
    assigned = materialize(_assigned(spark, sf), "assigned")
    flags = materialize(_flags(assigned), "flags")
    per_burst = bursts.detect_bursts(_truth(spark, sf), bursts.burst_majority(assigned), flags)
    return materialize(per_burst, "per_burst"), flags


@query(
    "burst_detection",
    SQL_DETECT + f""" SELECT burst_id, topic_label, {iso_sql('burst_start')} AS burst_start, majority_cluster, round(purity, 6) AS purity,
      detected, round(latency_seconds, 6) AS latency_seconds FROM per_burst""",
)
def burst_detection(spark, sf):
    per_burst, _ = _detected(spark, sf)
    return rounded(per_burst.withColumn("burst_start", times.iso(F.col("burst_start"))), "purity", "latency_seconds")


@query("detection_summary", SQL_DETECT + SQL_DETECT_SUMMARY + f" SELECT {SQL_RATES}, n_bursts, n_false_positive_clusters FROM detection")
def detection_summary(spark, sf):
    per_burst, flags = _detected(spark, sf)
    return rounded(bursts.detection_summary(per_burst, flags), *RATES)


@query(
    "false_positive_clusters",
    SQL_DETECT + """ SELECT DISTINCT cluster_id FROM flags
      WHERE cluster_id NOT IN (SELECT majority_cluster FROM per_burst WHERE detected)""",
)
def false_positive_clusters(spark, sf):
    per_burst, flags = _detected(spark, sf)
    return bursts.false_positives(flags, per_burst)


@query("flagged_clusters", SQL_DETECT + " SELECT cluster_id, count(*) AS n_flags FROM flags GROUP BY cluster_id")
def flagged_clusters(spark, sf):
    return _flags(_assigned(spark, sf)).groupBy("cluster_id").agg(F.count("*").alias("n_flags"))


# Sliding windows, with the user standing in for the cluster found in each window.
SQL_WINDOWS = f"""asg AS (SELECT post_id, cluster_id, epoch_us(ts) AS us FROM assigned),
  b AS (SELECT min(us) AS lo, max(us) AS hi FROM asg),
  refresh AS (SELECT k AS refresh_no, lo + {24 * HOUR} + k * {6 * HOUR} AS t FROM b, (SELECT unnest(generate_series(0, 100000)) AS k)
    WHERE lo + {24 * HOUR} + k * {6 * HOUR} <= hi + {6 * HOUR}),
  member AS (SELECT refresh_no, t, post_id, cluster_id FROM refresh JOIN asg ON us > t - {24 * HOUR} AND us <= t)"""
SQL_SLIDE = f"WITH {SQL_USER_POSTS}, {SQL_TRUTH}, {SQL_INJECTED}, {SQL_ASSIGNED}, {SQL_WINDOWS}"


def _members(spark, sf):
    return sliding.window_members(_assigned(spark, sf), 24.0, 6.0)


@query(
    "window_membership",
    SQL_SLIDE + f" SELECT refresh_no, {iso_sql('make_timestamp(t)')} AS refresh_ts, count(*) AS n_posts, count(DISTINCT post_id) AS n_ids FROM member GROUP BY ALL",
)
def window_membership(spark, sf):
    counted = _members(spark, sf).groupBy("refresh_no", "refresh_ts").agg(
        F.count("*").alias("n_posts"), F.count_distinct("post_id").alias("n_ids")
    )
    return counted.withColumn("refresh_ts", times.iso(F.col("refresh_ts")))


@query(
    "refresh_cost",
    SQL_SLIDE + """ SELECT count(*) AS n_refreshes, CAST(sum(n) AS BIGINT) AS total_posts_reclustered FROM (
      SELECT refresh_no, count(*) AS n FROM member GROUP BY ALL HAVING count(*) >= 5)""",
)
def refresh_cost(spark, sf):
    _, _, grid, counted = _paned(spark, sf)
    return sliding.pane_cost(counted, grid, 5)


SQL_LOG = """, sz AS (SELECT refresh_no, t, cluster_id AS tracked_id, count(*) AS size FROM member GROUP BY ALL),
  log AS (SELECT sz.refresh_no, sz.t, sz.tracked_id, sz.size, p.size IS NULL AS is_new,
    CASE WHEN p.size IS NULL THEN 'Infinity'::DOUBLE ELSE sz.size / p.size END AS growth_ratio
    FROM sz LEFT JOIN sz p ON p.tracked_id = sz.tracked_id AND p.refresh_no = sz.refresh_no - 1),
  flagged AS (SELECT *, CASE WHEN is_new THEN size >= 5 ELSE growth_ratio >= 2.0 END AS surging FROM log)"""


def _paned(spark, sf):
    """The bursts and their posts, the refreshes, and all posts counted by pane; the events themselves are only read."""
    truth = _truth(spark, sf)
    placed = _placed(spark, sf, truth)
    injected = materialize(placed.filter("burst_id is not null").select("post_id", "cluster_id", "timestamp"), "injected")
    assigned = placed.select("post_id", F.col("cluster_id").alias("tracked_id"), "timestamp")
    grid = sliding.RefreshGrid.of(assigned, 24.0, 6.0)
    counted = materialize(sliding.panes(assigned, grid, ["tracked_id"]), "panes")
    return truth, injected.withColumnRenamed("cluster_id", "tracked_id"), grid, counted


def _refresh_log(counted, grid):
    return sliding.refresh_log(sliding.window_sizes(counted, grid, ["tracked_id"]))


@query(
    "surging_flags",
    SQL_SLIDE + SQL_LOG + f""" SELECT refresh_no, {iso_sql('make_timestamp(t)')} AS refresh_ts, tracked_id, size, is_new,
      CASE WHEN is_new THEN -1 ELSE round(growth_ratio, 6) END AS growth_ratio, surging FROM flagged""",
)
def surging_flags(spark, sf):
    _, _, grid, counted = _paned(spark, sf)
    log = _refresh_log(counted, grid)
    flagged = log.withColumn("surging", scoring.surging(F.col("is_new"), F.col("size"), F.col("growth_ratio")))
    return flagged.select(
        "refresh_no",
        times.iso(F.col("refresh_ts")).alias("refresh_ts"),
        "tracked_id",
        "size",
        "is_new",
        F.when(F.col("is_new"), F.lit(-1.0)).otherwise(F.round("growth_ratio", 6)).alias("growth_ratio"),
        "surging",
    )


SQL_OVERLAP = """, ov AS (SELECT CAST(regexp_extract(post_id, '^injected_([0-9]+)_', 1) AS INTEGER) AS burst_id, t, cluster_id, count(*) AS overlap
    FROM member WHERE post_id LIKE 'injected%' GROUP BY ALL),
  overlap AS (SELECT burst_id, cluster_id AS majority_cluster, overlap FROM (SELECT ov.*, row_number() OVER (PARTITION BY ov.burst_id
    ORDER BY overlap DESC, t, cluster_id) AS rn FROM ov JOIN truth ON ov.burst_id = truth.burst_id
    AND make_timestamp(t) BETWEEN burst_start AND burst_end + INTERVAL 6 HOUR) WHERE rn = 1),
  flags AS (SELECT tracked_id AS cluster_id, make_timestamp(t) AS ts FROM flagged WHERE surging),
  hit AS (SELECT tr.burst_id, min(ts) AS first_flag FROM truth tr JOIN overlap o ON tr.burst_id = o.burst_id JOIN flags
    ON flags.cluster_id = o.majority_cluster AND ts BETWEEN burst_start AND burst_end + INTERVAL 6 HOUR GROUP BY 1),
  per_burst AS (SELECT tr.burst_id, topic_label, burst_start, majority_cluster, coalesce(overlap, 0) AS overlap, first_flag IS NOT NULL AS detected,
    (epoch_us(first_flag) - epoch_us(burst_start)) / 1000000.0::DOUBLE AS latency_seconds
    FROM truth tr LEFT JOIN overlap o ON tr.burst_id = o.burst_id LEFT JOIN hit ON tr.burst_id = hit.burst_id)"""


def _sliding_detected(spark, sf):
    """Per burst results, surging flags and cost."""
    truth, injected, grid, counted = _paned(spark, sf)
    log = materialize(_refresh_log(counted, grid), "log")
    per_burst, flags = sliding.evaluate_refreshes(log, sliding.window_members(injected, grid=grid), truth)
    return materialize(per_burst, "per_burst"), flags, sliding.pane_cost(counted, grid, 5)


@query(
    "sliding_detection",
    SQL_SLIDE + SQL_LOG + SQL_OVERLAP + f""" SELECT burst_id, topic_label, {iso_sql('burst_start')} AS burst_start, majority_cluster, overlap,
      detected, round(latency_seconds, 6) AS latency_seconds FROM per_burst""",
)
def sliding_detection(spark, sf):
    per_burst, _, _ = _sliding_detected(spark, sf)
    return rounded(per_burst.withColumn("burst_start", times.iso(F.col("burst_start"))), "latency_seconds")


SQL_COST = """, cost AS (SELECT count(*) AS n_refreshes, CAST(sum(n) AS BIGINT) AS total_posts_reclustered FROM (
  SELECT refresh_no, count(*) AS n FROM member GROUP BY ALL HAVING count(*) >= 5))"""


@query(
    "sliding_summary",
    SQL_SLIDE + SQL_LOG + SQL_OVERLAP + SQL_DETECT_SUMMARY + SQL_COST
    + f" SELECT {SQL_RATES}, n_bursts, n_false_positive_clusters, n_refreshes, total_posts_reclustered FROM detection, cost",
)
def sliding_summary(spark, sf):
    per_burst, flags, cost = _sliding_detected(spark, sf)
    return rounded(sliding.with_cost(bursts.detection_summary(per_burst, flags), cost), *RATES)


@query(
    "method_comparison",
    SQL_DETECT + SQL_DETECT_SUMMARY + """, n AS (SELECT count(*) AS n FROM assigned)
    SELECT 'dynamic (online)' AS method, round(detection_rate, 6) AS detection_rate, round(precision, 6) AS precision,
      round(median_latency_seconds / 3600.0, 6) AS median_latency_hours, n AS posts_processed FROM detection, n
    UNION ALL SELECT * FROM (""" + SQL_SLIDE + SQL_LOG + SQL_OVERLAP + SQL_DETECT_SUMMARY + SQL_COST
    + """ SELECT 'sliding window', round(detection_rate, 6), round(precision, 6), round(median_latency_seconds / 3600.0, 6),
      total_posts_reclustered FROM detection, cost)""",
)
def method_comparison(spark, sf):
    per_burst, flags = _detected(spark, sf)
    online = bursts.detection_summary(per_burst, flags)
    slid, slid_flags, cost = _sliding_detected(spark, sf)
    sliding_scores = bursts.detection_summary(slid, slid_flags)
    n_posts = _assigned(spark, sf).agg(F.count("*").alias("posts_processed"))
    processed = cost.select(F.col("total_posts_reclustered").alias("posts_processed"))
    compared = bursts.compare_methods(online, sliding_scores, n_posts, processed)
    return rounded(compared, "detection_rate", "precision", "median_latency_hours")


@query(
    "evaluation_report",
    SQL_DETECT + SQL_DETECT_SUMMARY + """, d AS (SELECT 'burst' AS section, * FROM (UNPIVOT (SELECT detection_rate, median_latency_seconds,
      p90_latency_seconds, precision, recall, f1, n_bursts::DOUBLE AS n_bursts, n_false_positive_clusters::DOUBLE AS n_false_positive_clusters
      FROM detection) ON COLUMNS(*) INTO NAME metric VALUE value)),
    o AS (SELECT 'corpus' AS section, 'n_posts' AS metric, count(*)::DOUBLE AS value FROM assigned)
    SELECT section, metric, round(value, 6) AS value FROM (SELECT * FROM d UNION ALL SELECT * FROM o)""",
)
def evaluation_report(spark, sf):
    per_burst, flags = _detected(spark, sf)
    size = _assigned(spark, sf).agg(F.count("*").alias("n_posts"))
    sections = {"burst": bursts.detection_summary(per_burst, flags), "corpus": size}
    return rounded(report.evaluation_report(sections), "value")
