"""Readers of landed files and state tables, and the sinks."""
