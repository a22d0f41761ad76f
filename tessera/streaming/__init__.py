"""Structured Streaming forms of ingestion, windows and expiring state."""
