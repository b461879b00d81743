"""Windowed and stateful operators, in batch and as Structured Streaming."""
