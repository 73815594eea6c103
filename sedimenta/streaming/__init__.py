"""Incremental ingestion from streams."""
