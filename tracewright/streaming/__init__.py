"""Structured Streaming: pipeline events, windows, incremental ingest, keyed state."""
