"""Structured Streaming forms of the trackers and rollups."""
