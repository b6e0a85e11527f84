"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.runtime import BROADCAST_MAX_ROWS, discard, merged, scratch_path


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", keys: list[str] | None = None) -> DataFrame:
    """``[keys,] node, component``: the smallest node id of each connected set of nodes.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every node links its
    larger neighbours, then its smaller ones, to its least neighbour, until nothing changes. Each
    step is a grouped minimum and a join. A round is one job: it is written out, so no lineage piles
    up, and its count and checksum are observed in the same write. The table of the round before is
    removed. ``keys`` separate independent graphs that are solved in the same rounds.
    """
    keys = keys or []
    spark = edges.sparkSession
    pairs = edges.select(*keys, F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    pairs = pairs.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path, mark = _written(pairs, keys)
    while mark["n"]:
        pairs = spark.read.schema(pairs.schema).parquet(path)
        after, now = _written(_small_star(_large_star(pairs, keys), keys), keys)
        discard(spark, path)
        path = after
        if now == mark:
            break
        mark = now
    pairs = spark.read.schema(pairs.schema).parquet(path)
    leaves = pairs.groupBy(*keys, "u").agg(F.min("v").alias("component")).select(*keys, F.col("u").alias("node"), "component")
    roots = pairs.select(*keys, F.col("v").alias("node")).distinct().join(leaves, [*keys, "node"], "left_anti")
    return leaves.unionByName(roots.withColumn("component", F.col("node")))


def tree_roots(parents: DataFrame, src: str = "src", dst: str = "dst", keys: list[str] | None = None) -> DataFrame:
    """``[keys,] node, root`` of a forest in which every row links a node to its one parent; roots have no row.

    Every round each node's link is replaced by its parent's link, so paths halve: as many rounds as the logarithm of the depth, each
    one join and one written table.
    """
    keys = keys or []
    spark = parents.sparkSession
    links, path, rows = parents.select(*keys, F.col(src).alias("node"), F.col(dst).alias("root")), None, 0
    while True:
        seen, after = Observation(), scratch_path(spark, "roots")
        if path is None:
            links.observe(seen, F.count(F.lit(1)).alias("moved")).write.parquet(after)
        else:
            then = links.select(*keys, F.col("node").alias("root"), F.col("root").alias("further"))
            stepped = links.join(then if rows <= BROADCAST_MAX_ROWS else merged(then), [*keys, "root"], "left").select(*keys, "node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
            stepped.observe(seen, F.count_if("moved").alias("moved")).drop("moved").write.parquet(after)
            discard(spark, path)
        path, links = after, spark.read.schema(links.schema).parquet(after)
        rows = rows or seen.get["moved"]
        if not seen.get["moved"]:
            return links


def _written(pairs: DataFrame, keys: list[str]) -> tuple[str, dict]:
    """The table's path, and its row count and an order-free checksum."""
    seen = Observation()
    path = scratch_path(pairs.sparkSession, "edges")
    marks = [F.count(F.lit(1)).alias("n")] + [
        F.sum(F.pmod(F.xxhash64(F.lit(seed), *keys, "u", "v"), F.lit((1 << 31) - 1))).alias(f"s{seed}") for seed in (0, 1)
    ]
    pairs.observe(seen, *marks).write.parquet(path)
    return path, seen.get


def _edge(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _large_star(pairs: DataFrame, keys: list[str]) -> DataFrame:
    both = pairs.select(*keys, F.inline(F.array(_edge("u", "v"), _edge("v", "u"))))
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
    linked = both.filter("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.filter("u <> v")


def _small_star(pairs: DataFrame, keys: list[str]) -> DataFrame:
    least = pairs.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    linked = pairs.join(least, [*keys, "u"]).select(*keys, F.inline(F.array(_edge("v", "m"), _edge("u", "m"))))
    return linked.filter("u <> v").distinct()
