"""Structured Streaming entry points and batch sinks."""
