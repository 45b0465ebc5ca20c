"""Structured Streaming forms of the import and event paths."""
