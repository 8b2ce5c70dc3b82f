"""Structured Streaming forms of the merge, the tiering and the deduplication."""
