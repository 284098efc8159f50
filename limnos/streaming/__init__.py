"""Structured Streaming forms of the stream-safe operators (D01 daily
means, C01 time filter, B04 coercion)."""
