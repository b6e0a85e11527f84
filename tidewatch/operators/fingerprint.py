"""Order-independent fingerprints of a set of ids.

``corpus_fingerprint`` is one number for "the same or not". ``digest_tree`` also tells where two sets differ: ids are dealt to ranges of
their SHA-256, a range's sorted ids have one digest, and sixteen ranges in order have the digest of their digests, up to one root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.runtime import materialize

# Ids the exact form joins to one line of its text.
PIECE_IDS = 256
# Rows a range of the digest tree holds at most, on average; the tree gets deeper, its ranges don't grow.
RANGE_ROWS = 1_000


def corpus_fingerprint(df: DataFrame, id_column: str = "post_id") -> DataFrame:
    """One row ``n_ids, fingerprint``: a digest of count, sum and xor of the ids' hashes.

    Every part merges, so it runs as one map-side-combined aggregate at any size.
    """
    h = F.conv(F.substring(F.sha2(F.col(id_column).cast("string"), 256), 1, 15), 16, 10).cast("bigint")
    parts = df.select(h.alias("h")).agg(
        F.count("*").alias("n_ids"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("s"),
        F.bit_xor("h").alias("x"),
    )
    joined = F.concat_ws(
        "|", F.col("n_ids").cast("string"), F.coalesce("s", F.lit(0)).cast("string"), F.coalesce("x", F.lit(0)).cast("string")
    )
    return parts.select("n_ids", F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, part`` in order to ``part, at, n_ids, piece``: the ids of a stretch joined by line ends, null where it holds none."""
    at = 0
    for batch in batches:
        for first in range(0, batch.num_rows, PIECE_IDS):
            rows = batch.slice(first, PIECE_IDS)
            ids = rows.column(0).drop_null().to_pylist()
            columns = [rows.column(1).slice(0, 1), pa.array([at]), pa.array([rows.num_rows]), pa.array(["\n".join(ids) if ids else None], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "n_ids", "piece"])
            at += 1


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pieces in order to one row ``n_ids, fingerprint``; one batch of them is held at a time."""
    n, digest, begun = 0, hashlib.sha256(), False
    for batch in batches:
        for n_ids, piece in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            n += n_ids
            if piece is not None:
                if begun:
                    digest.update(b"\n")
                digest.update(piece.encode())
                begun = True
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([digest.hexdigest()[:16]])], names=["n_ids", "fingerprint"])


def exact_fingerprint(df: DataFrame, id_column: str = "post_id") -> DataFrame:
    """First 16 hex digits of the SHA-256 of all sorted ids, one per line, at any number of ids.

    Sorting and joining are spread over the tasks. The digest itself takes the pieces one after the other, as every block of a SHA-256
    needs the block before it; ``digest_tree`` is the form without such a chain.
    """
    ids = df.select(F.col(id_column).cast("string").alias("id")).orderBy("id")
    pieces = ids.withColumn("part", F.spark_partition_id()).mapInArrow(_pieces, "part int, at bigint, n_ids bigint, piece string")
    # so that the only task has a row even if there are no ids
    start = df.sparkSession.range(1).select(F.lit(-1).alias("part"), "id", F.lit(0).cast("bigint").alias("n_ids"), F.lit(None).cast("string").alias("piece"))
    chain = pieces.union(start).repartition(1).sortWithinPartitions("part", "at")
    return chain.mapInArrow(_digest, "n_ids bigint, fingerprint string")


def same_corpus(a: DataFrame, b: DataFrame, id_column: str = "post_id") -> DataFrame:
    """One row ``same``: whether two tables hold the same ids."""
    left = corpus_fingerprint(a, id_column).select(F.col("fingerprint").alias("a"))
    right = corpus_fingerprint(b, id_column).select(F.col("fingerprint").alias("b"))
    return left.join(right, F.col("a") == F.col("b"), "full").select(
        F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same")
    ).limit(1)


def tree_depth(n_rows: int) -> int:
    """Levels below the root for a table of so many rows; equal tables have equal depths."""
    depth = 0
    while RANGE_ROWS * 16**depth < n_rows:
        depth += 1
    return depth


def _ranges(df: DataFrame, depth: int, id_column: str) -> DataFrame:
    """``prefix, n_ids, digest`` of the lowest ranges. Rows of one id are counted before ids are dealt, so a hot id is one entry."""
    hashed = df.filter(F.col(id_column).isNotNull()).groupBy(F.sha2(F.col(id_column).cast("string"), 256).alias("h")).agg(F.count("*").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("h", "n"))), lambda x: F.concat(x["h"], F.lit(":"), x["n"].cast("string")))
    return hashed.groupBy(F.substring("h", 1, depth).alias("prefix")).agg(
        F.sum("n").alias("n_ids"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest")
    )


def digest_tree(df: DataFrame, id_column: str = "post_id", depth: int | None = None) -> DataFrame:
    """``level, prefix, n_ids, digest`` of every range that holds an id, the root at level 0 with an empty prefix.

    Rows are counted, so a repeated id is not the same as one row of it. A row without an id has no part; an empty table has no rows.
    """
    depth = tree_depth(df.count()) if depth is None else depth
    level = materialize(_ranges(df, depth, id_column), "ranges")
    nodes = level.select(F.lit(depth).alias("level"), "prefix", "n_ids", "digest")
    for at in range(depth - 1, -1, -1):
        digests = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"])
        above = level.groupBy(F.substring("prefix", 1, at).alias("up")).agg(F.sum("n_ids").alias("n_ids"), F.sha2(F.array_join(digests, ""), 256).alias("digest"))
        level = above.withColumnRenamed("up", "prefix")
        nodes = nodes.unionByName(level.select(F.lit(at).alias("level"), "prefix", "n_ids", "digest"))
    return nodes


def differing_ranges(a: DataFrame, b: DataFrame, id_column: str = "post_id", depth: int | None = None) -> DataFrame:
    """``prefix, n_a, n_b``: the lowest ranges in which two tables differ; only their ids need to be looked at again."""
    if depth is None:
        depth = max(tree_depth(a.count()), tree_depth(b.count()))
    left = _ranges(a, depth, id_column).select("prefix", F.col("n_ids").alias("n_a"), F.col("digest").alias("a"))
    right = _ranges(b, depth, id_column).select("prefix", F.col("n_ids").alias("n_b"), F.col("digest").alias("b"))
    zero = F.lit(0).cast("bigint")
    both = left.join(right, "prefix", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("prefix", F.coalesce("n_a", zero).alias("n_a"), F.coalesce("n_b", zero).alias("n_b"))
