"""Structured Streaming: ingest, windows, online clustering and state changes."""
