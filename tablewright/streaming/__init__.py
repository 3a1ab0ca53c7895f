"""Snapshot tables as sinks of Structured Streaming."""
