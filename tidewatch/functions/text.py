"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the Unicode standard lists it, for trimming and for squeezing.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
COMMUNITY_PATTERN = "/r/([^/]+)/"
TITLE_CHARS = 80
TEXT_MODES = ("text", "title_text")


def stripped(c: Column) -> Column:
    """Null as empty, outer white space removed."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")), F.lit(WHITESPACE))


def squeezed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    blanks = F.translate(F.coalesce(c, F.lit("")), WHITESPACE, " " * len(WHITESPACE))
    return F.trim(F.regexp_replace(blanks, " {2,}", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c, F.lit(WHITESPACE)) == "")


def community_of(url: Column) -> Column:
    """Community name in a permalink, else ``unknown``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), COMMUNITY_PATTERN, 1)
    return F.when(found == "", F.lit("unknown")).otherwise(found)


def title_prefix(text: Column, n: int = TITLE_CHARS) -> Column:
    return F.substring(text, 1, n)


def prefixed_id(prefix: str, raw: Column) -> Column:
    return F.concat(F.lit(prefix), raw.cast("string"))


def content_id(prefix: str, *parts: Column) -> Column:
    """Id from the row's own content, for inputs that carry none."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\u0001", *filled), 256))


def joined_parts(*parts: Column) -> Column:
    """Non-empty ones of two squeezed parts, separated by one blank."""
    return F.trim(F.concat_ws(" ", *parts))


def embedding_text(text_mode: str, title: Column, text: Column) -> Column:
    """The text that is embedded: the body, or title and body when they differ."""
    if text_mode not in TEXT_MODES:
        raise ValueError(f"unknown text mode {text_mode!r}, expected one of {TEXT_MODES}")
    body = F.coalesce(text, F.lit(""))
    if text_mode == "text":
        return body
    head = F.coalesce(title, F.lit(""))
    return F.when((head != "") & (head != body), F.concat(head, F.lit(". "), body)).otherwise(body)


def burst_of(post_id: Column) -> Column:
    """Number of the burst a post was injected for, null for any other post."""
    found = F.regexp_extract(post_id, r"^injected_(\d+)_", 1)
    return F.when(found != "", found.cast("int"))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on the given values."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
