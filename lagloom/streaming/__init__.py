"""Structured Streaming forms of the loaders and rollups."""
