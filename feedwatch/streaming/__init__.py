"""Structured Streaming forms of the stateful flows."""
