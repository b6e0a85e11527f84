"""Session helpers: settings, durable intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be broadcast only after a count has shown it has at most this many rows.
BROADCAST_MAX_ROWS = 20_000


def build_session(app: str = "tidewatch", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job here relies on (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a task has one core, so its matrix products have one thread
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        **conf,
    }
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # for the workers of a local session, which inherit it
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = getattr(spark, "_tidewatch_dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark._tidewatch_dir = fallback
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidewatch-{uuid.uuid4().hex}/{name}"


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists and is not empty, on any file system Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and len(files.listStatus(folder)) > 0


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch table of this job that nothing reads any more."""
    if "/tidewatch-" not in path:
        raise ValueError(f"not a scratch table: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative work in a way that survives lost executors, and gives the
    optimizer the true size of the intermediate table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``df`` as a broadcast local table when at most ``max_rows`` rows, else ``df`` written out.

    The rows are computed once either way; beyond the bound the join stays a shuffle join.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return materialize(df, "stats")


def is_small(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, as the size of a compressed file says little about its rows."""
    return df.hint("merge")


def small_or_merged(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """A written table as a side of a join: broadcast when a count shows at most ``max_rows`` rows, else sorted and merged."""
    return F.broadcast(df) if is_small(df, max_rows) else merged(df)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the table has fewer files than the session has cores.

    For work that is heavy per row; a table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """The shuffle a window or grouped function over ``keys`` needs, at full width.

    Adaptive execution would merge partitions by their size; where each row grows or costs much
    after the shuffle, all partitions are wanted.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def side_by_side(parts: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Tables with at most one row per key set beside one another, by a union and a grouping.

    No join, and so no cross join where there are no keys.
    """
    keys = keys or []
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in keys])
