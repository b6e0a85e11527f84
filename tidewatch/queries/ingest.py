"""Sources, cleaning, merging, scalar columns, timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scoring, times
from tidewatch.functions import text as tx
from tidewatch.operators import fingerprint, timeline
from tidewatch.queries.registry import (
    SQL_DOC_POSTS,
    SQL_EVENT_POSTS,
    doc_posts,
    event_posts,
    iso_sql,
    query,
    rounded,
    table,
)
from tidewatch.runtime import scratch_path, spread
from tidewatch.sources import bundle, corpus, readers, submissions


def _iso(df, *cols):
    return df.withColumns({c: times.iso(F.col(c)) for c in cols})


@query(
    "platform_windows",
    f"""WITH {SQL_EVENT_POSTS}
    SELECT platform, {iso_sql('min(ts)')} AS min_timestamp, {iso_sql('max(ts)')} AS max_timestamp, count(ts) AS n_posts
    FROM event_posts GROUP BY platform""",
)
def platform_windows(spark, sf):
    return _iso(timeline.platform_windows(event_posts(spark, sf)), "min_timestamp", "max_timestamp")


@query("platform_counts", f"WITH {SQL_EVENT_POSTS} SELECT platform, count(*) AS n_posts FROM event_posts GROUP BY platform")
def platform_counts(spark, sf):
    return timeline.platform_counts(event_posts(spark, sf))


@query(
    "daily_platform_pivot",
    f"""WITH {SQL_EVENT_POSTS}
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) FILTER (platform = 'p0') AS p0,
      count(*) FILTER (platform = 'p1') AS p1, count(*) FILTER (platform = 'p2') AS p2,
      count(*) FILTER (platform = 'p3') AS p3
    FROM event_posts GROUP BY 1""",
)
def daily_platform_pivot(spark, sf):
    daily = timeline.daily_counts(event_posts(spark, sf), ["p0", "p1", "p2", "p3"])
    return daily.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "overlap_posts",
    f"""WITH {SQL_EVENT_POSTS}, w AS (SELECT min(ts) a, max(ts) b FROM event_posts GROUP BY platform)
    SELECT post_id, platform, {iso_sql('ts')} AS ts FROM event_posts
    WHERE ts BETWEEN (SELECT max(a) FROM w) AND (SELECT min(b) FROM w)""",
)
def overlap_posts(spark, sf):
    inside = timeline.restrict_to_overlap(event_posts(spark, sf))
    return inside.select("post_id", "platform", times.iso(F.col("timestamp")).alias("ts"))


@query(
    "aligned_timeline",
    f"""WITH {SQL_EVENT_POSTS},
    w AS (SELECT platform, epoch_us(min(ts)) lo, epoch_us(max(ts)) hi FROM event_posts GROUP BY platform),
    m AS (SELECT post_id, platform, ts,
      (SELECT min(lo) FROM w) + CAST(round((epoch_us(ts) - lo) *
        CASE WHEN hi > lo THEN 30.0 * 86400000000.0::DOUBLE / (hi - lo) ELSE 1.0 END) AS BIGINT) AS us
      FROM event_posts JOIN w USING (platform))
    SELECT post_id, platform, {iso_sql('make_timestamp(us)')} AS ts, {iso_sql('ts')} AS timestamp_original,
      'aligned' AS timeline_mode FROM m""",
)
def aligned_timeline(spark, sf):
    aligned = timeline.align_timelines(event_posts(spark, sf))
    return _iso(aligned, "timestamp", "timestamp_original").select(
        "post_id", "platform", F.col("timestamp").alias("ts"), "timestamp_original", "timeline_mode"
    )


def _turn_posts(spark, sf):
    """Conversation turns under their conversation's id: ids repeat, so cleaning has work to do."""
    conv = table(spark, sf, "conversations")
    return conv.select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("post_id"),
        F.col("role").alias("title"),
        F.when(F.col("role") == "assistant", F.col("text")).otherwise(F.concat(F.lit(" \n"), F.col("text"))).alias("text"),
        F.col("role").alias("source"),
        F.lit("chat").alias("platform"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60).alias("timestamp"),
    )


SQL_TURN_POSTS = """turn_posts AS (
  SELECT 'conv_' || conv_id AS post_id, role AS title,
    CASE WHEN role = 'assistant' THEN text ELSE ' ' || chr(10) || text END AS text, role AS source, 'chat' AS platform,
    make_timestamp(CAST((1704067200 + turn * 60) * 1000000 AS BIGINT)) AS ts FROM conversations)"""


@query(
    "clean_corpus",
    f"""WITH {SQL_TURN_POSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ts, text) rn
      FROM turn_posts WHERE trim(text, ' ' || chr(10)) <> '')
    SELECT post_id, title, md5(text) AS text_md5, length(text) AS n_chars, {iso_sql('ts')} AS ts FROM r WHERE rn = 1""",
)
def clean_corpus(spark, sf):
    kept = corpus.clean_corpus(_turn_posts(spark, sf))
    return kept.select(
        "post_id",
        "title",
        F.md5("text").alias("text_md5"),
        F.length("text").cast("bigint").alias("n_chars"),
        times.iso(F.col("timestamp")).alias("ts"),
    )


@query(
    "merge_master",
    f"""WITH {SQL_DOC_POSTS}, e AS (
      SELECT post_id, 'kept' AS source, title, ts FROM doc_posts
      WHERE post_id IN (SELECT 'doc_' || doc_id FROM labels))
    SELECT post_id, source, title, {iso_sql('ts')} AS ts FROM e
    UNION ALL SELECT post_id, source, title, {iso_sql('ts')} FROM doc_posts WHERE post_id NOT IN (SELECT post_id FROM e)""",
)
def merge_master(spark, sf):
    incoming = doc_posts(spark, sf)
    known = table(spark, sf, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("post_id"))
    existing = incoming.join(known, "post_id", "left_semi").withColumn("source", F.lit("kept"))
    merged = corpus.merge_master(incoming, existing)
    return merged.select("post_id", "source", "title", times.iso(F.col("timestamp")).alias("ts"))


@query(
    "normalized_text",
    """SELECT 'reddit_' || doc_id AS post_id, trim(regexp_replace(lang || chr(10) || source, '\\s+', ' ', 'g')) AS title,
      md5(trim(regexp_replace(lang || chr(10) || source, '\\s+', ' ', 'g')) || ' ' ||
          trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5,
      strftime(make_timestamp(CAST((1704067200 + n_chars) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS ts,
      lang AS source FROM documents""",
)
def normalized_text(spark, sf):
    raw = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"),
        F.concat_ws("\n", "lang", "source").alias("title"),
        F.col("text").alias("selftext"),
        F.col("lang").alias("subreddit"),
        (F.lit(1704067200) + F.col("n_chars")).cast("double").alias("created_utc"),
    )
    parsed = submissions.parse_submissions(raw)
    return parsed.select(
        "post_id", "title", F.md5("text").alias("text_md5"), times.iso(F.col("timestamp")).alias("ts"), "source"
    )


@query(
    "embedding_text",
    f"""WITH {SQL_DOC_POSTS}
    SELECT post_id, md5(text) AS text_only, md5(CASE WHEN title <> '' AND title <> text THEN title || '. ' || text
      ELSE text END) AS title_and_text FROM doc_posts""",
)
def embedding_text(spark, sf):
    df = doc_posts(spark, sf)
    return df.select(
        "post_id",
        F.md5(tx.embedding_text("text", F.col("title"), F.col("text"))).alias("text_only"),
        F.md5(tx.embedding_text("title_text", F.col("title"), F.col("text"))).alias("title_and_text"),
    )


@query(
    "community_from_url",
    """WITH u AS (SELECT page_id, url FROM pages UNION ALL
      SELECT -1 - event_id, CASE WHEN event_type = 'error' THEN NULL ELSE
        'https://forum.example.com/r/' || event_type || '/comments/' || event_id || '/' END FROM events)
    SELECT page_id, coalesce(nullif(regexp_extract(coalesce(url, ''), '/r/([^/]+)/', 1), ''), 'unknown') AS community FROM u""",
)
def community_from_url(spark, sf):
    links = table(spark, sf, "events").select(
        (F.lit(-1) - F.col("event_id")).alias("page_id"),
        F.when(
            F.col("event_type") != "error",
            F.concat(
                F.lit("https://forum.example.com/r/"), "event_type", F.lit("/comments/"), F.col("event_id").cast("string"), F.lit("/")
            ),
        ).alias("url"),
    )
    urls = table(spark, sf, "pages").select("page_id", "url").unionByName(links)
    return urls.select("page_id", tx.community_of(F.col("url")).alias("community"))


FINGERPRINT_SQL = """h AS (SELECT CAST('0x' || substr(sha256({id}), 1, 15) AS BIGINT) AS h FROM {src}),
  fp AS (SELECT count(*) AS n_ids, substr(sha256(count(*) || '|' || sum(h) || '|' || bit_xor(h)), 1, 16) AS fingerprint FROM h)"""


@query("fingerprint", f"WITH {SQL_EVENT_POSTS}, {FINGERPRINT_SQL.format(id='post_id', src='event_posts')} SELECT * FROM fp")
def corpus_fingerprint(spark, sf):
    return fingerprint.corpus_fingerprint(event_posts(spark, sf))


@query(
    "fingerprint_exact",
    f"""WITH {SQL_EVENT_POSTS} SELECT count(*) AS n_ids,
    substr(sha256(string_agg(post_id, chr(10) ORDER BY post_id)), 1, 16) AS fingerprint FROM event_posts""",
)
def exact_fingerprint(spark, sf):
    return fingerprint.exact_fingerprint(event_posts(spark, sf))


DEEPEST = 6


def ranges_sql(ids: str, src: str, depth: str, tag: str = "") -> str:
    """CTE ``leaf``: the lowest ranges of a digest tree over the column ``ids`` of ``src``."""
    return f"""hashed{tag} AS (SELECT sha256(CAST({ids} AS VARCHAR)) AS h, count(*) AS n FROM {src} WHERE {ids} IS NOT NULL GROUP BY ALL),
  leaf{tag} AS (SELECT substr(h, 1, ({depth})) AS prefix, sum(n)::BIGINT AS n_ids,
    sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS digest FROM hashed{tag} GROUP BY ALL)"""


def depth_sql(src: str) -> str:
    terms = " + ".join(f"(count(*) > {fingerprint.RANGE_ROWS * 16**k})::INT" for k in range(DEEPEST))
    return f"SELECT {terms} FROM {src}"


def tree_sql() -> str:
    """CTEs ``node{DEEPEST}`` to ``node0``: each level is the lowest ranges, where they are of that level, or folded from the one below."""
    parts = [f"node{DEEPEST} AS (SELECT prefix, n_ids, digest FROM leaf WHERE (SELECT d FROM depth) = {DEEPEST})"]
    for k in range(DEEPEST - 1, -1, -1):
        parts.append(
            f"""node{k} AS (SELECT prefix, n_ids, digest FROM leaf WHERE (SELECT d FROM depth) = {k} UNION ALL
            SELECT substr(prefix, 1, {k}), sum(n_ids)::BIGINT, sha256(string_agg(digest, '' ORDER BY prefix)) FROM node{k + 1} GROUP BY 1)"""
        )
    return ", ".join(parts)


@query(
    "fingerprint_tree",
    f"""WITH {SQL_EVENT_POSTS}, depth AS ({depth_sql('event_posts').replace('FROM', 'AS d FROM', 1)}),
    {ranges_sql('post_id', 'event_posts', 'SELECT d FROM depth')}, {tree_sql()}
    {" UNION ALL ".join(f"SELECT {k} AS level, prefix, n_ids, digest FROM node{k}" for k in range(DEEPEST + 1))}""",
)
def fingerprint_tree(spark, sf):
    return fingerprint.digest_tree(event_posts(spark, sf))


@query(
    "fingerprint_differences",
    f"""WITH depth AS (SELECT greatest(({depth_sql('documents')}), ({depth_sql('labels')})) AS d),
    {ranges_sql('doc_id', 'documents', 'SELECT d FROM depth', '_a')}, {ranges_sql('doc_id', 'labels', 'SELECT d FROM depth', '_b')}
    SELECT prefix, coalesce(a.n_ids, 0) AS n_a, coalesce(b.n_ids, 0) AS n_b FROM leaf_a a FULL JOIN leaf_b b USING (prefix)
    WHERE a.digest IS DISTINCT FROM b.digest""",
)
def fingerprint_differences(spark, sf):
    """The ranges of ids in which judged and all documents differ."""
    return fingerprint.differing_ranges(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "bundle_freshness",
    """SELECT 'events' AS corpus, count(*) = 0 AS fresh FROM (SELECT event_id FROM events EXCEPT ALL SELECT event_id FROM events) UNION ALL
    SELECT 'documents', count(*) = 0 FROM ((SELECT event_id FROM events EXCEPT ALL SELECT doc_id FROM documents)
      UNION ALL (SELECT doc_id FROM documents EXCEPT ALL SELECT event_id FROM events)) UNION ALL
    SELECT 'shifted', count(*) = 0 FROM (SELECT event_id FROM events EXCEPT ALL SELECT event_id + 1 FROM events)""",
)
def bundle_freshness(spark, sf):
    """A stored bundle of the events against the events, against the documents, and against as many other ids."""
    ev = table(spark, sf, "events").select(F.col("event_id").alias("post_id"))
    corpora = {
        "events": ev,
        "documents": table(spark, sf, "documents").select(F.col("doc_id").alias("post_id")),
        "shifted": ev.select((F.col("post_id") + 1).alias("post_id")),
    }
    marks = {name: fingerprint.corpus_fingerprint(df).first()["fingerprint"] for name, df in corpora.items()}
    folder = scratch_path(spark, "bundle")
    bundle.save_bundle(spark, folder, {"corpus_fingerprint": marks["events"]})
    stored = bundle.load_bundle(spark, folder)
    return spark.createDataFrame([(name, bundle.bundle_is_fresh(stored, mark)) for name, mark in marks.items()], "corpus string, fresh boolean")


@query(
    "bundle_round_trip",
    f"""WITH {SQL_EVENT_POSTS} SELECT 'dynamic_assignments' AS piece, post_id, platform, {iso_sql('ts')} AS ts FROM event_posts UNION ALL
    SELECT 'static_labels', post_id, source, NULL FROM event_posts""",
)
def bundle_round_trip(spark, sf):
    """Two pieces written by two runs and read back; what the second run does not give stays."""
    p = event_posts(spark, sf)
    folder = scratch_path(spark, "bundle")
    bundle.save_bundle(spark, folder, {"run": 1}, static_labels=p.select("post_id", "source"))
    bundle.save_bundle(spark, folder, {"run": 2}, dynamic_assignments=p.select("post_id", "platform", "timestamp"))
    back = bundle.load_bundle(spark, folder)
    first = back["dynamic_assignments"].select(F.lit("dynamic_assignments").alias("piece"), "post_id", "platform", times.iso(F.col("timestamp")).alias("ts"))
    second = back["static_labels"].select(F.lit("static_labels").alias("piece"), "post_id", F.col("source").alias("platform"), F.lit(None).cast("string").alias("ts"))
    return first.unionByName(second)


@query(
    "evaluation_csvs",
    f"""WITH {SQL_EVENT_POSTS} SELECT platform, source, count(*) AS n_posts, {iso_sql('min(ts)')} AS first_post FROM event_posts GROUP BY platform, source""",
)
def evaluation_csvs(spark, sf):
    """An evaluation table as its CSV file says."""
    per_platform = event_posts(spark, sf).groupBy("platform", "source").agg(F.count("*").alias("n_posts"), F.min("timestamp").alias("first_post"))
    written = bundle.save_evaluation_csvs(scratch_path(spark, "evaluation"), eval_per_platform=per_platform, sweep_results=per_platform.limit(0))
    return spark.read.schema("platform string, source string, n_posts bigint, first_post string").csv(written, header=True)


@query(
    "recent_posts",
    f"""WITH {SQL_EVENT_POSTS} SELECT post_id, source, {iso_sql('ts')} AS ts FROM event_posts
    ORDER BY event_posts.ts DESC, post_id DESC LIMIT 500""",
)
def recent_posts(spark, sf):
    newest = corpus.most_recent(event_posts(spark, sf), 500)
    return newest.select("post_id", "source", times.iso(F.col("timestamp")).alias("ts"))


@query(
    "chronological_order",
    f"WITH {SQL_EVENT_POSTS} SELECT post_id, source, {iso_sql('ts')} AS ts FROM event_posts ORDER BY event_posts.ts, post_id",
)
def chronological_order(spark, sf):
    ordered = event_posts(spark, sf).orderBy("timestamp", "post_id")
    return ordered.select("post_id", "source", times.iso(F.col("timestamp")).alias("ts"))


@query(
    "platform_or_all",
    f"""WITH {SQL_EVENT_POSTS} SELECT 'p1' AS wanted, platform, count(*) AS n FROM event_posts WHERE platform = 'p1' GROUP BY ALL
    UNION ALL SELECT 'none' AS wanted, platform, count(*) AS n FROM event_posts GROUP BY ALL""",
)
def platform_or_all(spark, sf):
    base = event_posts(spark, sf)
    parts = [
        timeline.platform_counts(corpus.platform_or_all(base, wanted)).select(
            F.lit(wanted).alias("wanted"), "platform", F.col("n_posts").alias("n")
        )
        for wanted in ("p1", "none")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "parsed_times",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS from_epoch,
      strftime(CASE WHEN event_type = 'error' THEN NULL ELSE ts END, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS lenient,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS strict,
      strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS day_us
    FROM events""",
)
def parsed_times(spark, sf):
    ev = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    text = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    day = F.date_trunc("day", F.col("t"))
    return ev.select(
        "event_id",
        times.iso(times.from_epoch(F.floor(F.unix_micros("t") / 1_000_000))).alias("from_epoch"),
        times.iso(times.lenient(F.when(F.col("event_type") == "error", F.col("props")).otherwise(text))).alias("lenient"),
        times.iso(times.strict(text)).alias("strict"),
        F.date_format(day, "yyyy-MM-dd").alias("day"),
        (times.micros(F.col("t")) - times.micros(day)).alias("day_us"),
    )


@query(
    "state_columns",
    """SELECT event_id, CASE WHEN (g >= 0.25 OR z >= 2.5) AND w >= 0.5 THEN 'trending' WHEN g > 1e-9 THEN 'rising'
        WHEN g < -1e-9 THEN 'declining' ELSE 'dormant' END AS state,
      round(power(2.0, -greatest(dt, 0) / 21600.0), 6) AS decay, round((greatest(g, 0) + z / 10) / 2, 6) AS score
    FROM (SELECT event_id, value / 20 - 1 AS g, (event_id % 7) / 2.0 AS z, (event_id % 4) / 3.0 AS w,
      (event_id % 50000) - 100.0 AS dt FROM events)""",
)
def state_columns(spark, sf):
    from tidewatch.schema import TrendParams

    ev = table(spark, sf, "events").select(
        "event_id",
        (F.col("value") / 20 - 1).alias("g"),
        ((F.col("event_id") % 7) / 2.0).alias("z"),
        ((F.col("event_id") % 4) / 3.0).alias("w"),
        ((F.col("event_id") % 50000) - 100.0).alias("dt"),
    )
    scored = ev.select(
        "event_id",
        scoring.state_of(F.col("g"), F.col("w"), F.col("z"), TrendParams()).alias("state"),
        scoring.decay_factor(F.col("dt"), 21600.0).alias("decay"),
        scoring.combined_score(F.col("g"), F.col("z") / 10).alias("score"),
    )
    return rounded(scored, "decay", "score")


@query(
    "source_union",
    """WITH r AS (SELECT 'reddit_kaggle_' || event_id AS post_id, trim(event_type || ' ' || props) AS text,
        event_type AS source, 'reddit' AS platform, date_trunc('second', ts) AS ts FROM events),
      t AS (SELECT 'twitter_' || doc_id AS post_id, trim(text, ' ' || chr(10)) AS text, 'covid_vaccine' AS source,
        'twitter' AS platform, TIMESTAMP '2021-01-05 10:00:00' + to_seconds(CAST(doc_id AS BIGINT)) AS ts FROM documents)
    SELECT post_id, source, platform, md5(text) AS text_md5, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS ts
    FROM (SELECT * FROM r UNION ALL SELECT * FROM t) WHERE text <> ''""",
)
def source_union(spark, sf):
    """Whole tables written in the two raw file formats, then read back through the readers."""
    ev, docs = table(spark, sf, "events"), table(spark, sf, "documents")
    tsv, csv = scratch_path(spark, "reddit_tsv"), scratch_path(spark, "twitter_csv")
    ev.select(
        F.col("event_id").alias("post_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("create_utc"),
        F.concat(F.lit("https://forum.example.com/r/"), "event_type", F.lit("/comments/x/")).alias("post_url"),
        F.concat_ws(" ", "event_type", "props").alias("title"),
    ).write.csv(tsv, sep="\t", header=True, quote="", escape="")
    docs.select(
        F.col("doc_id").alias("id"),
        F.date_format(F.timestamp_seconds(F.lit(1609840800) + F.col("doc_id")), "yyyy-MM-dd HH:mm:ss").alias("date"),
        "text",
    ).write.csv(csv, header=True, quote='"', escape='"', quoteAll=True)
    union = readers.load_all_sources(spark, {"reddit": tsv, "twitter": csv, "unheard_of": tsv})
    return union.select(
        "post_id", "source", "platform", F.md5("text").alias("text_md5"), times.iso(F.col("timestamp")).alias("ts")
    )


@query(
    "comment_source",
    """SELECT source, count(*) AS n_posts, count(DISTINCT post_id) AS n_ids, min(length(title)) AS min_title FROM (
      SELECT sha256(coalesce(role, '') || chr(1) || 'turn ' || turn || chr(1) || text || chr(1) || '2023-03-01') AS post_id,
        'turn ' || turn AS title, role AS source FROM conversations WHERE text <> '') GROUP BY source""",
)
def comment_source(spark, sf):
    conv = table(spark, sf, "conversations")
    raw = conv.select(
        F.col("role").alias("TOPIC"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("Video Title"),
        F.col("text").alias("comment"),
        F.lit("2023-03-01").alias("Published Date"),
    )
    mapped = readers.youtube_posts(raw)
    return mapped.groupBy("source").agg(
        F.count("*").alias("n_posts"),
        F.count_distinct("post_id").alias("n_ids"),
        F.min(F.length("title")).cast("bigint").alias("min_title"),
    )


@query(
    "feed_sample",
    """WITH s AS (SELECT text, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, ts FROM documents JOIN events ON doc_id = event_id
        ORDER BY 2, 1 LIMIT 300)
    SELECT 'bluesky_' || sha256(created_at || chr(1) || text) AS post_id, substr(trim(text, ' ' || chr(10)), 1, 80) AS title,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS ts FROM s""",
)
def feed_sample(spark, sf):
    docs = doc_posts(spark, sf)
    raw = docs.select("text", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"))
    sample = readers.bluesky_posts(raw, 300)
    return sample.select("post_id", "title", times.iso(F.col("timestamp")).alias("ts"))
