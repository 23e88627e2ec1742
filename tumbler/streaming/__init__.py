"""Structured Streaming forms of retrieval dedupe and running statistics."""
