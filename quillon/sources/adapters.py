"""Telemetry records of every kind, projected from the star-schema tables.

Each kind is a table name and a list of column expressions that both engines
accept, so that a query and its oracle start from the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.plans.dialect import DUCK, SPARK

_ENV = "case {id} % 3 when 0 then 'production' when 1 then 'staging' end"
_EVENT_STATUS = "case when event_type = 'error' then 500 when event_id % 10 = 0 then 404 else 200 end"
_CYCLE = "case event_id % 7 when 0 then 'hit' when 1 then 'miss' when 2 then 'set' when 3 then 'put' when 4 then 'forget' when 5 then 'delete' else 'fail' end"


def projection(kind: str, d) -> tuple[str, dict[str, str], str]:
    """Source table, {column: expression} and row condition of a record kind."""
    env = lambda key: _ENV.format(id=key)
    if kind == "requests":
        return "events", {
            "id": "event_id", "created_at": "ts", "ts_us": d.micros("ts"), "group_hash": "md5(event_type)", "user_id": "cast(user_id as string)",
            "environment": env("user_id"), "status_code": _EVENT_STATUS, "duration": "cast(floor(value * 1000) as bigint)", "route_methods": "'[\"GET\"]'",
            "route_path": "'/' || event_type", "url": "'https://app.example/' || event_type", "trace_id": "cast(event_id as string)", "server": "'srv-' || cast(event_id % 4 as string)",
        }, "true"
    if kind == "spans":  # requests long enough to overlap
        return "events", {"id": "event_id", "created_at": "ts", "ts_us": d.micros("ts"), "environment": env("user_id"), "duration": "cast(floor(value * 10) as bigint) * 1000000"}, "true"
    if kind == "exceptions":
        return "events", {
            "id": "event_id", "created_at": "ts", "ts_us": d.micros("ts"), "fingerprint": "md5(event_type || '|' || cast(user_id % 7 as string))", "class": "'E' || cast(user_id % 7 as string)",
            "message": "'boom ' || cast(event_id % 5 as string)", "server": "'srv-' || cast(event_id % 4 as string)", "user_id": "case when user_id % 11 = 0 then '' else cast(user_id as string) end",
            "handled": "case when user_id % 13 = 0 then null else value < 200 end", "environment": env("user_id"), "trace_id": "cast(event_id as string)",
        }, "event_type = 'error'"
    if kind == "cache_events":
        return "events", {
            "id": "event_id", "created_at": "ts", "key": "'user:' || cast(user_id as string) || ':' || event_type", "event_type": _CYCLE, "store": "case when user_id % 2 = 0 then 'redis' end",
            "duration": "cast(floor(value) as bigint)", "environment": env("user_id"),
        }, "true"
    if kind == "logs":
        return "events", {"id": "event_id", "created_at": "ts", "level": "case event_type when 'error' then 'error' when 'view' then 'debug' else 'info' end", "context": "props", "environment": env("user_id"), "trace_id": "cast(event_id as string)"}, "true"
    if kind == "jobs":
        return "orders", {
            "id": "o_orderkey", "created_at": "o_orderdate", "group_hash": "md5(o_orderpriority)", "attempt_id": "case when o_orderstatus <> 'O' then 'a' || cast(o_orderkey as string) end",
            "status": "case o_orderstatus when 'O' then 'queued' when 'F' then 'processed' else case when o_orderkey % 2 = 0 then 'failed' else 'released' end end", "job_class": "'Job' || substr(o_orderpriority, 1, 1)",
            "queue": "o_orderpriority", "duration": "cast(floor(o_totalprice * 10) as bigint)", "user_id": "case when o_custkey % 10 = 0 then null else cast(o_custkey % 150 as string) end", "environment": env("o_orderkey"),
        }, "true"
    if kind == "queries":
        return "lineitem", {
            "id": "l_orderkey * 10 + l_linenumber", "created_at": "l_shipdate", "ts_us": d.micros("l_shipdate"), "group_hash": "l_returnflag", "connection": "l_linestatus", "sql_query": "'select ' || l_returnflag || cast(l_suppkey % 5 as string)",
            "duration": "cast(floor(l_extendedprice) as bigint)", "execution_id": "cast(l_orderkey as string)", "environment": env("l_orderkey"),
        }, "true"
    if kind in ("mail", "notifications"):
        own = {"mailable": "'Mail' || substr(o_orderpriority, 1, 1)"} if kind == "mail" else {"notification": "'Note' || substr(o_orderpriority, 1, 1)", "channel": "o_orderpriority"}
        return "orders", {
            "id": "o_orderkey", "created_at": "o_orderdate", "group_hash": "md5(substr(o_orderpriority, 1, 1))", "queued": "case when o_orderkey % 17 = 0 then null else o_orderstatus = 'O' end", "failed": "o_orderstatus = 'P'",
            "duration": "case when o_orderkey % 5 = 0 then null else cast(floor(o_totalprice) as bigint) end", "environment": env("o_orderkey"), **own,
        }, "true"
    if kind in ("commands", "scheduled"):
        own = {"exit_code": "case when o_orderkey % 19 = 0 then null else cast(o_orderkey % 3 as int) end"}
        if kind == "scheduled":
            own = {"status": "case o_orderkey % 4 when 0 then 'processed' when 1 then 'success' when 2 then 'failed' else 'skipped' end", "expression": "'*/5 * * * *'", "repeat_seconds": "o_orderkey % 60"}
        return "orders", {
            "id": "o_orderkey", "created_at": "o_orderdate", "group_hash": "md5(o_orderpriority)", "command": "'cmd:' || o_orderpriority",
            "duration": "case when o_orderkey % 7 = 0 then null else cast(floor(o_totalprice) as bigint) end", "environment": env("o_orderkey"), **own,
        }, "true"
    if kind == "outgoing":
        return "pages", {
            "id": "page_id", "created_at": d.from_micros("1704067200000000 + page_id * 1000000"), "group_hash": "md5(cast(page_id % 20 as string))", "url": "url",
            "status_code": "case page_id % 5 when 0 then 500 when 1 then 404 when 2 then null else 200 end", "duration": "page_id * 37 % 100000", "environment": env("page_id"),
        }, "true"
    if kind == "users":
        return "customer", {"seq": "c_custkey", "user_id": "cast(c_custkey % 150 as string)", "name": "c_name", "email": "c_mktsegment || cast(c_custkey as string)"}, "true"
    raise KeyError(kind)


def records(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Records of one kind; only the columns that a query uses are scanned."""
    table, columns, where = projection(kind, SPARK)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def records_sql(kind: str) -> str:
    table, columns, where = projection(kind, DUCK)
    return f"(select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {table} where {where})"
