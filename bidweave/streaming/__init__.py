"""Incremental ingest and event-time windows on Structured Streaming."""
