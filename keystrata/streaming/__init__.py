"""Structured Streaming: ingest and rate limits."""
