"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

1. Every whole text is cut into runs of letters, ``A-Z`` lower-cased; words are counted per task, then by a shuffle.
2. Two words with one edit between them share their first half or their last half, as cut in the shorter one. So a word of ``L`` letters goes to the blocks
   of length ``L`` (as one of the shorter or equal words) and of length ``L - 1`` (as one of the longer words), once with its first and once with its
   last half: adjacent lengths meet, and blocks stay small while the vocabulary grows.
3. In a block the letter counts of the words are the rows of a matrix. Its Gram matrix gives all squared distances; an edit changes them to
   at most two, so those pairs are kept and verified by their common beginnings and ends, as array operations.
4. Of the verified pairs each word keeps its number of near words and the most frequent of them, before anything is shuffled.

A block of more than ``TILE`` words is dealt into tiles by a hash; each pair of tiles is a cell of its own, so that a beginning that
a third of all words share is spread over tasks. A pair is found in exactly one cell. Small blocks are multiplied together, ``CHUNK`` words at a time.

A word's form is the near word with the largest count (ties: the smallest in code-point order) if it has at least ``RATIO`` times the word's count. As counts
grow by that factor, chains of forms are no longer than the logarithm of the largest count, and a few doublings follow them all.

Null and empty texts have no words; a null ``doc_id`` reads as an empty one; repeated rows count again; other columns are not read. Without
words the result is empty.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.crcsql import CRC_TABLE, crc32_sql
from tidewatch.llm.words import text_slices
from tidewatch.runtime import by_key, materialize

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
DELETED_EVERY = 31
# The letters of a word, a to z and U+00C0 to U+00FF.
LETTERS = "a-zÀ-ÿ"
N_LETTERS = 26 + 64
# Words that a task's table of counts holds, words of a tile, words multiplied together, pairs verified together.
HELD, TILE, CHUNK, PAIRS_HELD = 200_000, 1024, 256, 1 << 17


def count_words(docs: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """``word, n``: words of at least ``least`` letters over all texts, each run changed as ``as_written`` says."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of = re.compile(f"[{LETTERS}]{{{least},}}").findall
        total: Counter[str] = Counter()

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, data, offsets in text_slices(batch.column(1)):
                for k, doc_id in enumerate(ids[first:last]):
                    text = data[offsets[k] : offsets[k + 1]].tobytes().lower().decode()
                    for run, n in Counter(runs_of(text)).items():
                        word = as_written(doc_id, run)
                        if len(word) >= least:
                            total[word] += n
                if len(total) > HELD:
                    yield taken()
        yield taken()

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def as_written(doc_id: int | None, run: str) -> str:
    """The run, without one letter where the hash of document and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DELETED_EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _blocks(words: DataFrame, tile: int) -> DataFrame:
    """``block, lo, hi, tile, base, tail, word, n``: the words of every cell; blocks of one word are left out.

    ``base`` is the block's length and ``tail`` whether its words share their ends.
    """
    length = F.char_length("word")
    half = F.floor(F.col("base") / 2).cast("int")
    based = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("base"))
    sided = based.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("tail"))
    part = F.when(F.col("tail"), F.expr("right(word, base - floor(base / 2))")).otherwise(F.substring(F.col("word"), F.lit(1), half))
    keyed = sided.select(F.xxhash64("base", "tail", part).alias("block"), "base", "tail", "word", "n")
    sizes = keyed.groupBy("block").agg(F.count("*").alias("m")).filter("m > 1")
    tiles = F.ceil(F.col("m") / tile).cast("int")
    dealt = keyed.join(sizes, "block").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    lo, hi = F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")
    return dealt.select("block", lo, hi, "tile", "base", "tail", "word", "n")


def _codes(words: list[str], lengths: np.ndarray) -> np.ndarray:
    """Numbers of all letters, word after word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 128, points - 97, points - 0xC0 + 26)


def near_pairs(words: list[str], group: np.ndarray, base: np.ndarray, tail: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that are one edit apart, each once.

    ``cell`` is the row's tile, or -1 where all tiles of the group are one. Two longer words, and two of one tile of a split
    block, meet in another group; words sharing both halves meet where their first halves do.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = _codes(words, lengths)
    row = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(row * N_LETTERS + codes, minlength=len(words) * N_LETTERS).reshape(-1, N_LETTERS).astype(np.float32)
    gram = counts @ counts.T
    norms = gram.diagonal().copy()
    gram *= -2
    gram += norms
    gram += norms[:, None]
    i, j = np.nonzero(gram <= 2)
    fit = (i < j) & (group[i] == group[j]) & ((cell[i] < 0) | (cell[i] != cell[j])) & ((lengths[i] == base[i]) | (lengths[j] == base[j]))
    i, j = i[fit], j[fit]
    width = int(lengths.max(initial=0)) + 1
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.full((len(words), width), -1, np.int8)
    left[row, place] = codes
    right = np.full((len(words), width), -1, np.int8)
    right[row, np.repeat(lengths, lengths) - 1 - place] = codes
    kept_i, kept_j = [], []
    for at in range(0, len(i), PAIRS_HELD):
        a, b = i[at : at + PAIRS_HELD], j[at : at + PAIRS_HELD]
        begin = (left[a] != left[b]).argmax(axis=1)
        end = (right[a] != right[b]).argmax(axis=1)
        short, long = np.minimum(lengths[a], lengths[b]), np.maximum(lengths[a], lengths[b])
        one = np.where(short == long, begin + end == short - 1, begin + end >= short) & (long - short <= 1)
        one &= ~(tail[a] & (begin >= base[a] // 2))
        kept_i.append(a[one])
        kept_j.append(b[one])
    none = np.zeros(0, np.int64)
    return np.concatenate([*kept_i, none]), np.concatenate([*kept_j, none])


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _summed(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Per word of the pairs its number of near words, and the first of them by count, then name."""
    owner, other = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], owner))
    owner, other = owner[order], other[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(first, len(owner)))
    best = other[first]
    columns = [[words[k] for k in owner[first]], sizes, n[best], [words[k] for k in best]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NEAR)], schema=_NEAR)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``block, lo, hi`` to ``word, n_near, best_n, best`` of the cells they make."""
    carried: pa.Table | None = None

    def compared(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal carried
        keys = np.stack([rows.column(c).to_numpy() for c in ("block", "lo", "hi")])
        cuts = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.append(cuts, rows.num_rows)
        if not last:
            carried = rows.slice(int(starts[-1]))
            starts, ends = starts[:-1], ends[:-1]
        names = rows.column("word").to_pylist()
        n, base = rows.column("n").to_numpy(), rows.column("base").to_numpy().astype(np.int64)
        tail = rows.column("tail").to_numpy(zero_copy_only=False)
        cell = np.where(keys[1] == keys[2], -1, rows.column("tile").to_numpy())
        group = np.repeat(np.arange(len(starts)), ends - starts)
        at = 0
        while at < len(starts):
            until = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
            a, b = int(starts[at]), int(ends[until - 1])
            at = until
            if b - a < 2:
                continue
            i, j = near_pairs(names[a:b], group[a:b], base[a:b], tail[a:b], cell[a:b])
            if len(i):
                yield _summed(names[a:b], n[a:b], i, j)

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            yield from compared(pa.concat_tables([carried, rows]) if carried is not None else rows, False)
    if carried is not None and carried.num_rows:
        yield from compared(carried, True)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, n_near, best_n, best`` of the words of ``word, n`` that have near ones."""
    keys = ["block", "lo", "hi"]
    cells = by_key(_blocks(words, tile), *keys).sortWithinPartitions(*keys)
    parts = cells.mapInArrow(_compare, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("first")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def with_roots(formed: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """Adds ``root``: the last word on the way of forms; ``most`` is the largest count."""
    links = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    longest = max(1, math.floor(math.log(max(most, 2) / LEAST_COUNT, ratio)) + 1)
    for _ in range(math.ceil(math.log2(longest))):
        then = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that occurs at least ``least_count`` times."""
    words = materialize(count_words(docs).filter(F.col("n") >= least_count), "words")
    followed = F.col("best_n") >= ratio * F.col("n")
    formed = words.join(near_words(words, tile), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(followed, F.col("best")).alias("form"), F.when(followed, F.col("best_n")).alias("form_n")
    )
    formed = materialize(formed, "forms")
    most = formed.agg(F.max("n")).first()[0] or 0
    return with_roots(formed, most, ratio).select("word", "form", "root", "n", "n_near", "form_n")


SQL = f"""WITH RECURSIVE {CRC_TABLE},
  runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{LETTERS}]+')) AS run FROM documents),
  told AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
  hashed AS (SELECT run, k, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM told, crc_table),
  written AS (SELECT CASE WHEN h % {DELETED_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
  words AS (SELECT word, sum(k)::BIGINT AS n FROM written WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
  cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 40) r(i) WHERE i <= length(word)),
  pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
  best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
  formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form,
    CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
  way(word, form) AS (SELECT word, word FROM formed UNION ALL SELECT y.word, f.form FROM way y JOIN formed f ON f.word = y.form WHERE f.form IS NOT NULL),
  roots AS (SELECT y.word, y.form AS root FROM way y JOIN formed f ON f.word = y.form WHERE f.form IS NULL)
  SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""
