"""Names, callables and oracle SQL of every registered telemetry query."""

from __future__ import annotations

from quillon.plans import record_queries, rollup_queries

flagship = rollup_queries.p95_by_hour


def _all() -> dict:
    return rollup_queries.build() | record_queries.build()


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
