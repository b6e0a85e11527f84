"""Benchmark decontamination by suffix arrays of the training documents.

Documents are cut into shards (runs of rows of about ``SHARD_BYTES`` of text). Each shard gets a sorted array of
the word suffixes of its documents; every suffix of every benchmark item is looked up in it by binary search, which gives
its longest match up to a window and, as one range of the array, all its places. A match of a window's
words marks the window's words in each document. Windows that match one after another at neighbouring places are one verbatim match,
so the longest verbatim match of a document follows from the places, at any length.

* The benchmark is the stated query set: it is read in blocks of at most ``BLOCK_BYTES`` of text. The driver holds one block at a time, and
  what earlier blocks found is written out before the next one is read, so no plan carries more than one block.
* Suffixes that begin with a word no item of the block has can match nothing and are left out of the array; such a
  word ends the suffixes before it.
* Suffixes are ordered by their first ``window`` words. Words are the ranks of the block's vocabulary packed several
  to a 64-bit number, so that the order of numbers is the order of word sequences.

A null text has no words, and items without words give no window. The passages of an item with a null id are hit like others; having no
name it isn't among a document's items. Repeated rows are answered one by one;
items of equal id count once. A document without a match has ``n_hit = 0`` and no items. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import U64, Words, alphanumeric, text_slices
from tidewatch.runtime import materialize

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20


@dataclass
class TestSet:
    """The words of one block of items as ranks of the block's vocabulary (1, 2, ...; 0: no such word)."""

    vocabulary: np.ndarray
    item_ids: list[str | None]
    words: list[np.ndarray]
    window: int

    @property
    def per_key(self) -> int:
        return 64 // max(1, int(len(self.vocabulary) + 1).bit_length())

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), U64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(U64)

    def keys(self, ranks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The first ``window`` ranks from each start, zero from ``ends`` or a rank of zero on, packed."""
        width = U64(64 // self.per_key)
        out, open_ = [], np.ones(len(starts), bool)
        for first in range(0, self.window, self.per_key):
            key = np.zeros(len(starts), U64)
            for k in range(first, first + self.per_key):
                word = np.zeros(len(starts), U64)
                if k < self.window:
                    at = starts + k
                    open_ = open_ & (at < ends)
                    word[open_] = ranks[at[open_]]
                    open_ &= word > 0
                key = key << width | word
            out.append(key)
        return out


def test_set(rows: list[tuple[str | None, str]], window: int) -> TestSet:
    words = Words(alphanumeric())
    ids, hashed = [], []
    texts = pa.array([text for _, text in rows], pa.large_string())
    for first, last, data, offsets in text_slices(texts):
        starts, ends, doc = words.bounds(data, offsets)
        names = words.hashes(data, starts, ends)
        cuts = np.searchsorted(doc, np.arange(last - first + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), first):
            if b > a:
                ids.append(rows[i][0])
                hashed.append(names[a:b])
    vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, U64)
    out = TestSet(vocabulary, ids, [], window)
    out.words = [out.ranks(x) for x in hashed]
    return out


class SuffixArray:
    """The suffixes of one shard that begin with a word of the test set, in the order of their first words."""

    def __init__(self, tests: TestSet, ranks: np.ndarray, doc_ends: np.ndarray) -> None:
        places = np.flatnonzero(ranks)
        keys = tests.keys(ranks, places, doc_ends[places])
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
        self.places, self.keys = places[order], [k[order] for k in keys]
        self.tests = tests

    def _range(self, query: list[U64], depth: int) -> tuple[int, int]:
        """Where the suffixes stand whose first ``depth`` words are the query's."""
        per, width = self.tests.per_key, 64 // self.tests.per_key
        lo, hi = 0, len(self.places)
        for j, key in enumerate(self.keys):
            known = min(per, depth - j * per)
            if known <= 0 or lo >= hi:
                break
            free = (1 << (per - known) * width) - 1
            least = int(query[j]) & ~free
            part = key[lo:hi]
            lo, hi = lo + int(np.searchsorted(part, U64(least))), lo + int(np.searchsorted(part, U64(least | free), side="right"))
        return lo, hi

    def longest(self, query: list[U64], words: int) -> tuple[int, int, int]:
        """Length (up to a window) of the longest match of a test suffix, and its range of places."""
        known, unknown, found = 0, words + 1, (0, 0)
        while unknown - known > 1:
            depth = (known + unknown) // 2 if known or unknown <= words else words
            at = self._range(query, depth)
            if at[0] < at[1]:
                known, found = depth, at
            else:
                unknown = depth
        return known, *found


def _marked(tests: TestSet, ranks: np.ndarray, doc: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """``document, first word, words, item, the window's first word in it`` of every place of every window of the test set."""
    array = SuffixArray(tests, ranks, cuts[1:][doc])
    out = []
    if not len(array.places):
        return out
    heads = array.keys[0]
    for item, words in enumerate(tests.words):
        need = min(tests.window, len(words))
        starts = np.arange(len(words) - need + 1)
        keys = tests.keys(words, starts, np.full(len(starts), len(words)))
        # a suffix whose first packed words the shard hasn't got has no match of a window's length
        free = (1 << max(0, tests.per_key - need) * (64 // tests.per_key)) - 1
        least = keys[0] & ~U64(free)
        near = np.searchsorted(heads, least) < np.searchsorted(heads, least | U64(free), side="right")
        for s in starts[near].tolist():
            length, lo, hi = array.longest([k[s] for k in keys], need)
            if length == need:
                out += [(int(doc[p]), int(p), need, item, s) for p in array.places[lo:hi].tolist()]
    return out


def longest_matches(marked: list[tuple[int, int, int, int, int]], n: int) -> np.ndarray:
    """Words of the longest verbatim match of each of ``n`` documents, 0 without one."""
    out = np.zeros(n, np.int64)
    if marked:
        doc, place, words, item, start = np.array(marked, np.int64).T
        order = np.lexsort((start, place - start, item))
        doc, place, words, item, start = doc[order], place[order], words[order], item[order], start[order]
        breaks = (np.diff(item) != 0) | (np.diff(place - start) != 0) | (np.diff(start) != 1) | (np.diff(doc) != 0)
        first = np.flatnonzero(np.append(True, breaks))
        runs = np.diff(np.append(first, len(doc)))
        np.maximum.at(out, doc[first], words[first] + runs - 1)
    return out


def _matcher(tests: TestSet, shard_bytes: int):
    """Adds what one block of items finds to ``row, text, n_words, spans, items, longest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(alphanumeric())
        for batch in batches:
            counts, spans, items, longest = [], [], [], []
            for first, last, data, offsets in text_slices(batch.column(1), shard_bytes):
                starts, ends, doc = words.bounds(data, offsets)
                ranks = tests.ranks(words.hashes(data, starts, ends))
                cuts = np.searchsorted(doc, np.arange(last - first + 1))
                counts += np.diff(cuts).tolist()
                found = [[(x["first"], x["last"]) for x in before or ()] for before in batch.column(3)[first:last].to_pylist()]
                named = [set(before or ()) for before in batch.column(4)[first:last].to_pylist()]
                marked = _marked(tests, ranks, doc, cuts)
                for d, place, length, item, _ in marked:
                    found[d].append((place - int(cuts[d]), place - int(cuts[d]) + length))
                    if tests.item_ids[item] is not None:
                        named[d].add(tests.item_ids[item])
                before = batch.column(5)[first:last].to_numpy(zero_copy_only=False)
                longest += np.maximum(before, longest_matches(marked, last - first)).tolist()
                spans += [[{"first": a, "last": b} for a, b in merged(x)] for x in found]
                items += [sorted(x) for x in named]
            made = [pa.array(x, batch.schema.field(k).type) for k, x in ((2, counts), (3, spans), (4, items), (5, longest))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], batch.schema.names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def test_blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks; the driver holds one block and one partition of the items at a time."""
    block, held = [], 0
    rows = benchmark.select(F.col(id_column).cast("string"), F.col(text_column).cast("string"))
    for item, text in rows.toDF("item", "text").filter("text is not null").toLocalIterator():
        size = len(text.encode())
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += size
    if block:
        yield block


def matched_rows(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every row of ``docs`` as ``row``, with ``n_words``, the covered word ranges (``spans``, disjoint and in order), the ids of
    the ``items`` found and the words of the ``longest`` verbatim match. One pass for each block of the benchmark, without a shuffle."""
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(text_column).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first: long, last: long>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
        F.lit(0).cast("long").alias("longest"),
    )
    blocks = test_blocks(benchmark, item_column, item_text, block_bytes)
    block = next(blocks, [])
    while True:
        found = found.mapInArrow(_matcher(test_set(block, window), shard_bytes), found.schema)
        block = next(blocks, None)
        if block is None:
            return found.drop("text")
        found = materialize(found, "matched")


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``doc_id, n_words, spans, items, longest`` per row."""
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows = matched_rows(named, benchmark, **options)
    return rows.select("row.doc_id", "n_words", "spans", "items", "longest")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`matches`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window; all their columns."""
    return matched_rows(docs, benchmark, **options).filter(F.size("spans") == 0).select("row.*")
