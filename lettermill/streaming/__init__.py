"""Structured Streaming forms of ingest and statistics."""
