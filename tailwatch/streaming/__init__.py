"""Structured Streaming forms of the idempotent ingest operators."""
