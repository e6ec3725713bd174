"""Readers: wire frames, raw record families and table adapters."""
