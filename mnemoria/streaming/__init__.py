"""Incremental and stateful variants on Structured Streaming."""
