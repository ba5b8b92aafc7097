"""Scans: JSON lines, landed pages, binary assets and the vector index."""
