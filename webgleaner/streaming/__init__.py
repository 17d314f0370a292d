"""Structured Streaming jobs over the same column functions as the batch operators."""
