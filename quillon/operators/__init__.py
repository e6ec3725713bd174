"""Relational operators over telemetry records, rollups and issues."""
