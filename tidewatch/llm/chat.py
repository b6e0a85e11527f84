"""Chat formatting by prefix-target expansion, in column expressions only.

A turn is written ``<s>[role]text</s>``. Inside roles and texts the characters that could make up a marker are escaped
and can be read back: ``\\`` as ``\\e``, ``<`` as ``\\l``, ``[`` as ``\\b`` and, in roles, ``]`` as ``\\c``.

Every assistant turn becomes an example of its own: all turns before it as context, and its text as the only trainable
span. Turns after the last assistant turn, or a conversation without one, get one more example without a trainable span, so
nothing of a conversation is lost. A conversation of n turns thus yields text in proportion to the sum of its prefixes, as the
expansion demands.

Rows are ordered by turn (null first), then role, then text; repeated rows stay. Null texts and roles are empty. A null
conversation id is a conversation like any other. Other columns are ignored; an empty table gives no example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.quality import let

TRAINED_ROLE = "assistant"
ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b")]
ROLE_ESCAPES = [*ESCAPES, ("]", "\\c")]


def escaped(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for raw, written in pairs:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescaped(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for raw, written in reversed(pairs):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def expand(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: the trainable span in code points, empty where nothing is trained."""
    head = F.concat(F.lit("<s>["), escaped(F.coalesce(F.col(role).cast("string"), F.lit("")), ROLE_ESCAPES), F.lit("]"))
    body = escaped(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
            head.alias("head"),
            body.alias("body"),
        ).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    last = F.size("turns") - 1
    targets = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("at"), (t["role"] == TRAINED_ROLE).alias("trained"))),
        lambda x: x["trained"] | (x["at"] == last),
    )
    examples = turns.select("conv_id", "turns", F.posexplode(targets).alias("example", "target"))
    written = F.array_join(F.transform(F.slice("turns", 1, F.col("target.at") + 1), lambda t: F.concat(t["head"], t["body"], F.lit("</s>"))), "")
    own = F.get("turns", F.col("target.at"))
    made = examples.select("conv_id", (F.col("example") + 1).alias("example"), written.alias("text"), own["body"].alias("body"), F.col("target.trained").alias("trained"))
    end = F.char_length("text") - F.char_length(F.lit("</s>"))
    start = F.when(F.col("trained"), end - F.char_length("body")).otherwise(end)
    return made.select("conv_id", "example", "text", start.cast("long").alias("loss_start"), end.cast("long").alias("loss_end"))


def read_turns(text: Column) -> Column:
    """``array<struct<role, text>>``: the turns that a formatted text says."""
    marks = F.filter(F.split(text, "</s>"), lambda x: x != "")

    def parse(x: Column) -> Column:
        inner = F.substr(x, F.lit(len("<s>[") + 1))
        return let(inner, lambda y: let(F.substring_index(y, "]", 1), lambda r: F.struct(
            unescaped(r, ROLE_ESCAPES).alias("role"), unescaped(F.substr(y, F.char_length(r) + 2)).alias("text"))))

    return F.transform(marks, parse)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say when read back."""
    loss = unescaped(F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    read = examples.withColumn("loss", loss).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("trained"),
        F.sum(F.char_length("text")).cast("long").alias("formatted_chars"),
    )
    read = read.withColumn("turns", read_turns(F.col("whole"))).withColumn("loss", F.array_join("trained.loss", ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
             9 + length(role) + length(text) + length(role) - length(translate(role, '\<[]', ''))
             + length(text) - length(translate(text, '\<[', '')) AS size
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""
