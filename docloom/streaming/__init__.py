"""Incremental ingest of page texts and articles."""
