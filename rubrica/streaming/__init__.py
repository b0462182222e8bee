"""Structured Streaming versions of the run-log operators."""
