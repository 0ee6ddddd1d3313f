"""Incremental loads with Structured Streaming (file source + foreachBatch)."""

from carelens.streaming.ingest import load_batch, start_incremental_load  # noqa: F401
