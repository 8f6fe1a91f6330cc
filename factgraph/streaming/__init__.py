"""Structured Streaming forms of ingestion and its counters."""
