"""Structured Streaming forms of batch-scoped operators."""
