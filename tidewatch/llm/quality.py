"""Quality rules as a short-circuit cascade, in column expressions only.

Each rule is a rejecting condition and an estimate of its work. On a sample of at most ``SAMPLE_ROWS`` rows the share of rows
a rule rejects and its mean work are measured; the rule with the most rejections per work goes first, then the best
one on the rows that are left, and so on. The cascade is one CASE expression, so a row that is rejected costs nothing
more. The sample sets the order only: the verdict is the same in any order.

A null text has no words and is rejected as too short. Every row gives a row; other columns are kept or ignored as named.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_WORDS = 50, 200_000
SAMPLE_ROWS, SAMPLE_SHARE = 2_000, 0.01
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def count_in(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")


def repeat_words(w: Column) -> Column:
    """Words in windows of three words that stand twice or more in the text.

    The windows are sorted by their hash, so equal ones are neighbours; the covered words are counted from
    the distances of the places in order.
    """

    def windows(v: Column) -> Column:
        return F.array_sort(
            F.transform(
                F.slice(v, 1, F.greatest(F.size(v) - 2, F.lit(0))),
                lambda x, i: F.struct(F.xxhash64(x, F.get(v, i + 1), F.get(v, i + 2)).alias("h"), i.alias("i")),
            )
        )

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return let(let(let(w, windows), places), covered).cast("long")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``rejects`` holds; ``work`` estimates what deciding it costs, in character visits."""

    name: str
    rejects: Column
    work: Column


def rules(t: Column, w: Column) -> list[Rule]:
    """The rules over a text without nulls and the array of its words."""
    n, chars = F.size(w).cast("long"), F.char_length(t).cast("double")
    per_word = F.size(w).cast("double")
    return [
        Rule("too_short", n < MIN_WORDS, F.lit(1.0)),
        Rule("too_long", n > MAX_WORDS, F.lit(1.0)),
        Rule("word_length", let(count_in_words(t), lambda c: (c < 2 * n) | (c > 15 * n)), chars),
        Rule("symbols", 10 * count_in(t, SYMBOLS) > n, chars),
        Rule("capitals", 2 * F.regexp_count(t, F.lit("\\p{Lu}")) > count_in_words(t), 4 * chars),
        Rule("few_letters", 10 * F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))) < 7 * n, 2 * chars),
        Rule("dup_lines", let(lines_with_words(t), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x)), 3 * chars),
        Rule("few_distinct", 5 * F.size(F.array_distinct(w)) < n, 12 * per_word),
        Rule("repeats", 100 * repeat_words(w) > 50 * n, 60 * per_word),
    ]


def count_in_words(text: Column) -> Column:
    return F.char_length(F.translate(text, SPACES, "")).cast("long")


def prepared(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``row`` (all columns) and ``text`` without nulls."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))


def cascade_order(texts: DataFrame) -> list[str]:
    """The rules' names by rejections per work on the sample, each on the rows that the rules before it leave."""
    sample = texts.sample(False, SAMPLE_SHARE, 7).limit(SAMPLE_ROWS)
    t = F.col("text")
    found = rules(t, words(t))
    columns = [c for r in found for c in (r.rejects.alias(f"{r.name}_no"), r.work.alias(f"{r.name}_work"))]
    rows = [r.asDict() for r in sample.select(*columns).collect()]
    left, out = [r.name for r in found], []
    while left:
        best = max(left, key=lambda name: sum(r[f"{name}_no"] for r in rows) / max(1.0, sum(r[f"{name}_work"] for r in rows)))
        out.append(best)
        left.remove(best)
        rows = [r for r in rows if not r[f"{best}_no"]]
    return out


def verdict(text: Column, split: Column, order: list[str], without: tuple[str, ...] = ()) -> Column:
    """The name of the first rule of the cascade that rejects, null for a good text.

    The words are bound once, so the expression costs one split wherever the optimizer moves it.
    """

    def cascade(w: Column) -> Column:
        by_name = {r.name: r for r in rules(text, w)}
        out = None
        for name in order:
            if name not in without:
                out = (F.when if out is None else out.when)(by_name[name].rejects, F.lit(name))
        return out

    return let(split, cascade)


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    texts = prepared(docs, text_column)
    t = F.col("text")
    return texts.filter(verdict(t, words(t), cascade_order(texts)).isNull()).select("row.*")


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id, word statistics, whether a base rule fails, and the cascade's verdict."""
    texts = prepared(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    order = cascade_order(texts)
    t, w = F.col("text"), F.col("words")
    lines = let(lines_with_words(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    measured = texts.withColumn("words", words(t)).select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(w).cast("long").alias("n_words"),
        count_in_words(t).alias("word_chars"),
        count_in(t, SYMBOLS).alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        # the base columns decide the base rules already
        verdict(t, w, order, without=("too_short", "repeats")).isNull().alias("passed"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", F.col("passed") & ~F.col("base_failed")).drop("passed")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, ws[i + 1] AS a, ws[i + 2] AS b, ws[i + 3] AS c FROM p),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM h),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letters, len(list_distinct(ws)) AS n_distinct
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_words > 200000 OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_upper > word_chars OR 10 * n_letters < 7 * n_words OR 2 * n_dup_lines > n_lines OR 5 * n_distinct < n_words) AS kept
FROM f"""
