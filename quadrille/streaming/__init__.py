"""Continuous ingestion of quads."""
