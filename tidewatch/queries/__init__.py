"""Registered queries over the driver tables, each with its SQL where SQL can say the same."""

from tidewatch.queries.registry import QUERIES, SQL


def load_all() -> None:
    from tidewatch.queries import bursts, clustering, ingest, quality, streams, trend, vectors  # noqa: F401


__all__ = ["QUERIES", "SQL", "load_all"]
