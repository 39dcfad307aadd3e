"""Structured Streaming forms of ingest, windows and joins."""
