"""Incremental ingest of news files."""
