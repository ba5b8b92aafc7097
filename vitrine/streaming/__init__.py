"""Structured Streaming forms of ingest, upsert and near-duplicate removal."""
