"""Periodic runs of words: Lyndon arrays by suffix grouping, their roots extended to runs.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends. Every run has a Lyndon root under one of two
opposite orders of the words, and that root is the longest Lyndon word that begins at its place. So:

1. ``lyndon_array`` is the first phase of a grouping suffix sorter. Suffixes are grouped by their first word; groups are taken from the
   highest down. The blocks of a group are final: their length is the group's context. Each stretch of adjacent blocks of the group is
   appended to the block before it, which moves to a new group just above its old one, ordered by the number of blocks appended. No
   suffix array follows: the final lengths are the Lyndon array.
2. Both orders give roots; a root is extended in both directions by the longest common extension of the text with itself, one period
   on. A root inside a stretch already found with its period is not extended again.

Only runs of at least ``least`` words and ``repeats`` periods are wanted, ``repeats`` being 4 or more and ``least`` 6 or more. Then every
three words in a row of a run occur three times in the text. The arrays are made for the stretches of such words only; a run lies
whole in one of them, and ends there where it ends in the text, so nothing is lost. The cost of a text is linear in its words, but
for the common extensions, which compare bytes.

Null and empty texts have no words and no runs. Words are split at the six ASCII white-space bytes and nothing else. A null ``doc_id`` is kept;
repeated rows give repeated results; other columns are not read. A text passes whole through one task, with its words in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.words import text_slices

LEAST, REPEATS = 6, 4
# Words that are compared first by a common extension; doubled while they are equal.
FIRST_STEP = 8


def lyndon_array(letters: list[int], n_letters: int) -> list[int]:
    """Length of the longest Lyndon word that begins at each place; letters are ``0 .. n_letters - 1``, all of them used."""
    n = len(letters)
    members: list[list[int]] = [[] for _ in range(n_letters)]
    for i, c in enumerate(letters):
        members[c].append(i)
    context = [1] * n_letters
    below, above = list(range(-1, n_letters - 1)), list(range(1, n_letters + 1))
    group, final = list(letters), [0] * n
    starts = list(range(-1, n))  # of the block that ends before a place
    g = n_letters - 1
    while g >= 0:
        size = context[g]
        here = [i for i in members[g] if group[i] == g]
        grown: dict[tuple[int, int], list[int]] = {}
        k, m = 0, len(here)
        while k < m:
            first = end = here[k]
            while k < m and here[k] == end:
                final[end] = size
                end += size
                k += 1
            p = starts[first]
            # a final block before has no lower block before it, and so neither has this one
            if p >= 0 and not final[p]:
                starts[end] = p
                grown.setdefault((group[p], (end - first) // size), []).append(p)
        for old, count in sorted(grown, reverse=True):
            new, up = len(members), above[old]
            moved = grown[old, count]
            members.append(moved)
            context.append(context[old] + count * size)
            below.append(old)
            above.append(up)
            above[old] = new
            below[up] = new
            for p in moved:
                group[p] = new
        g = below[g]
    return final


def _common(data: bytes, i: int, j: int, n: int) -> int:
    """Equal 4-byte words of ``data`` from ``i`` on and from ``j`` on, ``i < j``."""
    k, size = 0, min(FIRST_STEP, n - j)
    while size and data[4 * (i + k) : 4 * (i + k + size)] == data[4 * (j + k) : 4 * (j + k + size)]:
        k += size
        size = min(2 * size, n - j - k)
    while size > 1:  # the first difference is among the next ``size``
        half = size // 2
        if data[4 * (i + k) : 4 * (i + k + half)] == data[4 * (j + k) : 4 * (j + k + half)]:
            k += half
            size -= half
        else:
            size = half
    return k


def stretch_runs(words: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> set[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one stretch of word numbers."""
    n = len(words)
    ranks = np.unique(words, return_inverse=True)[1].astype(np.int32)
    n_letters = int(ranks.max()) + 1
    forward, backward = ranks.tobytes(), ranks[::-1].tobytes()
    found = set()
    for letters in (ranks, n_letters - 1 - ranks):
        roots = np.array(lyndon_array(letters.tolist(), n_letters), np.int64)
        at = np.flatnonzero(roots * repeats <= n)
        after, before = at + roots[at], at - 1
        goes_on = ranks[np.minimum(after, n - 1)] == ranks[at]
        goes_on &= after < n
        goes_on |= (before >= 0) & (ranks[before] == ranks[after - 1])
        at = at[goes_on]
        ends: dict[int, int] = {}
        for i, q in zip(at.tolist(), roots[at].tolist()):
            if ends.get(q, 0) >= i + q:
                continue
            end = i + q + _common(forward, i, i + q, n)
            start = i - _common(backward, n - i - q, n - i, n)
            ends[q] = end
            if end - start >= max(least, repeats * q):
                found.add((start, end - start, q))
    return found


def _stretches(ids: np.ndarray, n_words: int) -> Iterator[tuple[int, int]]:
    """First word and word after the last of stretches whose threes of words occur three times in the text."""
    if len(ids) < LEAST:
        return
    pairs = ids[:-1] * n_words + ids[1:]
    if n_words > 1 << 20:  # so that the number of three words fits
        pairs = np.unique(pairs, return_inverse=True)[1]
    threes = pairs[:-1] * n_words + ids[2:]
    order = np.argsort(threes, kind="stable")
    same = np.diff(threes[order]) == 0
    often = np.flatnonzero(same[1:] & same[:-1])
    if not len(often):
        return
    marked = np.zeros(len(threes) + 2, np.int8)
    for k in range(3):
        marked[order[often + k] + 1] = 1
    edges = np.diff(marked)
    for first, last in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        if last + 2 - first >= LEAST:
            yield first, last + 2


def text_runs(words: list[bytes], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """Runs of a text by start, then period."""
    if least < LEAST or repeats < REPEATS:
        raise ValueError(f"runs are found from {LEAST} words and {REPEATS} periods on")
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    found = [(first + s, length, q) for first, last in _stretches(ids, len(numbers)) for s, length, q in stretch_runs(ids[first:last], least, repeats)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what repeats the first period of a run."""
    if not runs:
        return words
    dropped = bytearray(len(words))
    for start, length, q in runs:
        dropped[start + q : start + length] = b"\x01" * (length - q)
    return [w for w, d in zip(words, dropped) if not d]


_FOUND = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: runs by start, then period, and the text without their repeats, words joined by a space.

    ``rewrite`` changes the words of a document before they are looked at.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, data, offsets in text_slices(batch.column(1)):
                counts, runs, texts = [], [], []
                for k, doc_id in enumerate(ids[first:last]):
                    words = data[offsets[k] : offsets[k + 1]].tobytes().split()
                    if rewrite:
                        words = rewrite(doc_id, words)
                    found = text_runs(words, least, repeats)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(b" ".join(kept_words(words, found)))
                columns = [pa.array(ids[first:last], pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, _FOUND)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The periodic tail that the query's contract puts into every tenth document, by a hash of its id; a null id has none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def report(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select("doc_id", "n_words", "collapsed", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"))
    length = -F.col("top.less")
    return out.select(
        "doc_id",
        "n_runs",
        F.col("top.start").alias("start"),
        length.alias("length"),
        F.col("top.period").alias("period"),
        F.floor(length * 1000 / F.col("top.period")).alias("exponent_milli"),
        "runs_sha256",
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
