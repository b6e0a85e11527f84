"""Result bundles: a folder with one table per result, written piece by piece."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import times

LOGGER = logging.getLogger(__name__)

# Names of the pieces of a bundle and of the evaluation tables.
META = "run_meta"
PIECES = [
    "embeddings",
    "static_labels",
    "static_projection",
    "static_summary",
    "dynamic_assignments",
    "dynamic_history",
    "dynamic_summary",
    "evaluation",
]
EVALUATION_TABLES = ["eval_bursts", "eval_bursts_sliding_window", "sweep_results", "eval_per_platform"]


def save_bundle(spark: SparkSession, folder: str, run_meta: dict, **pieces: DataFrame | None) -> None:
    """Writes the given pieces; pieces written earlier and not given now stay."""
    unknown = set(pieces) - set(PIECES)
    if unknown:
        raise ValueError(f"unknown bundle pieces: {sorted(unknown)}")
    written_at = {"generated_at": datetime.now(timezone.utc).isoformat()}
    meta = written_at | {k: v for k, v in run_meta.items() if v or k not in written_at}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{folder}/{META}")
    for name, df in pieces.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_bundle(spark: SparkSession, folder: str) -> dict | None:
    """``{"run_meta": dict, piece: DataFrame or None, ...}``; None without readable ``run_meta``."""
    try:
        lines = spark.read.text(f"{folder}/{META}", wholetext=True).take(1)
        meta = json.loads(lines[0]["value"]) if lines else None
    except (PySparkException, json.JSONDecodeError) as error:
        LOGGER.warning("no readable bundle in %s: %s", folder, error)
        return None
    if meta is None:
        return None
    bundle: dict = {META: meta}
    for name in PIECES:
        try:
            bundle[name] = spark.read.parquet(f"{folder}/{name}")
        except PySparkException:
            bundle[name] = None
    return bundle


def bundle_is_fresh(bundle: dict, corpus_fingerprint: str) -> bool:
    """Whether the bundle was built from this corpus; a bundle without a fingerprint passes."""
    known = bundle[META].get("corpus_fingerprint")
    fresh = not known or known == corpus_fingerprint
    if not fresh:
        LOGGER.warning("bundle was built from another corpus (%s, now %s)", known, corpus_fingerprint)
    return fresh


def save_evaluation_csvs(folder: str, **tables: DataFrame | None) -> list[str]:
    """CSV folder per non-empty table; returns the paths written."""
    unknown = set(tables) - set(EVALUATION_TABLES)
    if unknown:
        raise ValueError(f"unknown evaluation tables: {sorted(unknown)}")
    written = []
    for name, df in tables.items():
        if df is None or df.isEmpty():
            continue
        path = f"{folder}/{name}"
        flat = df.select(*[times.iso(F.col(c)).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite").csv(path, header=True)
        written.append(path)
    return written
