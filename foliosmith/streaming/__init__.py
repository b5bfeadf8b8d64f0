"""Streaming: pages parsed as they arrive."""
