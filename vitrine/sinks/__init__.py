"""Sinks: JSON lines, CSV, raw landing and rejects."""
