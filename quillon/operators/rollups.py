"""Rollups: one declarative spec drives minute aggregation, merging and tiers.

Expressions are SQL strings that both Spark and the oracle accept. All measures
are additive or min/max, so partial aggregation, merging batches and folding
minutes into hours and days are the same groupBy.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from quillon.functions import histogram, sketch

TIERS = ("minute", "hour", "day")
_BAD = "status_code >= 400 and status_code < 500"


@dataclass(frozen=True)
class RollupSpec:
    name: str
    source: str
    keys: dict[str, str]
    counters: dict[str, str] = field(default_factory=dict)
    representatives: dict[str, str] = field(default_factory=dict)
    has_duration: bool = True
    has_histogram: bool = True
    duration_where: str = "true"
    has_duration_count: bool = False
    average_over: str = "call_count"

    def key_columns(self) -> list[str]:
        return [*self.keys, "bucket_start", "environment"]

    def measures(self) -> dict[str, str]:
        """{column: merge function} of everything that is not a key."""
        out = {"call_count": "sum"} | dict.fromkeys(self.counters, "sum")
        if self.has_duration:
            out |= {"total_duration": "sum", "min_duration": "min", "max_duration": "max"}
        if self.has_duration_count:
            out["duration_count"] = "sum"
        return out | dict.fromkeys(self.representatives, "min")


_GROUP = {"group_hash": "coalesce(group_hash, '')"}
_STATUS = {"success_count": "status_code < 400", "client_error_count": _BAD, "server_error_count": "status_code >= 500"}
_SENT = {"queued_count": "queued", "failed_count": "failed"}

SPECS = {
    s.name: s
    for s in (
        RollupSpec("qry", "queries", _GROUP | {"connection": "coalesce(connection, '')"}, representatives={"sql_query": "sql_query"}),
        RollupSpec("req", "requests", _GROUP, _STATUS, {"route_methods": "route_methods", "route_path": "route_path"}),
        RollupSpec(
            "job", "jobs", _GROUP,
            {"attempts_count": "attempt_id is not null", "queued_count": "attempt_id is null", "processed_count": "status = 'processed'", "released_count": "status = 'released'", "failed_count": "status = 'failed'"},
            {"job_class": "job_class", "queue": "queue"}, duration_where="attempt_id is not null", average_over="attempts_count",
        ),
        RollupSpec("out", "outgoing", _GROUP, _STATUS, {"host": "split_part(url, '/', 1) || '//' || split_part(url, '/', 3)"}),
        RollupSpec(
            "cache", "cache_events", {"key": "coalesce(key, '')", "store": "coalesce(store, '')"},
            {
                "hits": "event_type = 'hit'", "misses": "event_type = 'miss'", "writes": "event_type in ('set', 'put')", "deletes": "event_type in ('forget', 'delete')", "fails": "event_type = 'fail'",
                "delete_failures": "event_type in ('delete_fail', 'forget_fail')", "write_failures": "event_type in ('write_fail', 'set_fail', 'put_fail', 'fail')",
            }, has_histogram=False,
        ),
        RollupSpec("usr_req", "requests", {"user_id": "coalesce(user_id, '')"}, _STATUS, has_duration=False, has_histogram=False),
        RollupSpec("usr_job", "jobs", {"user_id": "coalesce(user_id, '')"}, {"attempts_count": "attempt_id is not null"}, has_duration=False, has_histogram=False),
        RollupSpec("usr_exc", "exceptions", {"user_id": "coalesce(user_id, '')"}, has_duration=False, has_histogram=False),
        RollupSpec(
            "exc", "exceptions", {"fingerprint": "coalesce(fingerprint, '')"},
            {"handled_count": "handled", "unhandled_count": "not coalesce(handled, false)", "authenticated_count": "user_id is not null and user_id <> ''"}, has_duration=False, has_histogram=False,
        ),
        RollupSpec("exc_srv", "exceptions", {"fingerprint": "coalesce(fingerprint, '')", "server": "coalesce(server, '')"}, has_duration=False, has_histogram=False),
        RollupSpec("mail", "mail", _GROUP, _SENT, {"mailable": "mailable"}, has_duration_count=True, average_over="duration_count"),
        RollupSpec("notif", "notifications", _GROUP | {"channel": "coalesce(channel, '')"}, _SENT, {"notification": "notification"}, has_duration_count=True, average_over="duration_count"),
        RollupSpec("cmd", "commands", _GROUP, {"successful_count": "exit_code = 0", "unsuccessful_count": "exit_code <> 0"}, {"command": "command"}, has_duration_count=True, average_over="duration_count"),
        RollupSpec(
            "sched", "scheduled", _GROUP, {"failed_count": "status = 'failed'", "processed_count": "status = 'processed' or status = 'success'", "skipped_count": "status = 'skipped'"},
            {"command": "command", "expression": "expression", "repeat_seconds": "repeat_seconds"}, has_duration_count=True, average_over="duration_count",
        ),
    )
}


def keyed(df: DataFrame, spec: RollupSpec, tier: str = "minute") -> DataFrame:
    bucket = F.date_trunc(tier, F.col("created_at")).cast("timestamp_ntz")
    return df.withColumns({k: F.expr(e) for k, e in spec.keys.items()}).withColumns({"bucket_start": bucket, "environment": F.coalesce("environment", F.lit(""))})


def aggregate(df: DataFrame, spec: RollupSpec, tier: str = "minute") -> DataFrame:
    """Rollup of raw records; a null predicate counts as no, an empty sum is 0."""
    timed = F.when(F.expr(spec.duration_where), F.col("duration")) if spec.has_duration else None
    aggs = [F.count("*").alias("call_count")] + [F.count_if(F.expr(p)).alias(c) for c, p in spec.counters.items()]
    if spec.has_duration:
        aggs += [F.coalesce(F.sum(timed), F.lit(0)).cast("long").alias("total_duration"), F.min(timed).alias("min_duration"), F.max(timed).alias("max_duration")]
    if spec.has_duration_count:
        aggs.append(F.count(timed).alias("duration_count"))
    aggs += [F.min(F.expr(e)).alias(c) for c, e in spec.representatives.items()]
    return keyed(df, spec, tier).groupBy(*spec.key_columns()).agg(*aggs)


def merge(parts: DataFrame, spec: RollupSpec) -> DataFrame:
    """Additive merge of rollup rows with equal keys; min and max skip nulls."""
    return parts.groupBy(*spec.key_columns()).agg(*[getattr(F, how)(c).alias(c) for c, how in spec.measures().items()])


def to_tier(rollup: DataFrame, spec: RollupSpec, tier: str) -> DataFrame:
    """Coarser rollup from a finer one, in UTC buckets."""
    return merge(rollup.withColumn("bucket_start", F.date_trunc(tier, "bucket_start").cast("timestamp_ntz")), spec)


def best_tier(low: dt.datetime, high: dt.datetime) -> str:
    """The coarsest tier whose buckets tile a window."""
    for tier, step in (("day", 86_400), ("hour", 3600)):
        if all((t - dt.datetime(1970, 1, 1)).total_seconds() % step == 0 for t in (low, high)):
            return tier
    return "minute"


def covers(rollup: DataFrame, low: dt.datetime, high: dt.datetime, step: dt.timedelta) -> bool:
    """The rollup's first and last buckets span the window; one row is read."""
    r = rollup.agg(F.min("bucket_start").alias("low"), F.max("bucket_start").alias("high")).first()
    return r["low"] is not None and r["low"] <= low and r["high"] + step >= high


def read_window(raw: DataFrame, stored: dict[str, DataFrame], spec: RollupSpec, low: dt.datetime, high: dt.datetime) -> DataFrame:
    """A window's rollup rows: of the coarsest stored tier that tiles and spans it, else made from raw rows."""
    steps = {"minute": dt.timedelta(minutes=1), "hour": dt.timedelta(hours=1), "day": dt.timedelta(days=1)}
    order = list(reversed(TIERS))
    for tier in order[order.index(best_tier(low, high)) :]:
        if tier in stored and covers(stored[tier], low, high, steps[tier]):
            return stored[tier].where((F.col("bucket_start") >= F.lit(low).cast("timestamp_ntz")) & (F.col("bucket_start") < F.lit(high).cast("timestamp_ntz")))
    return aggregate(raw.where((F.col("created_at") >= F.lit(low).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(high).cast("timestamp_ntz"))), spec, best_tier(low, high))


def durations(df: DataFrame, spec: RollupSpec, tier: str = "minute") -> DataFrame:
    return keyed(df.where(spec.duration_where).where("duration is not null"), spec, tier)


def histogram_rows(df: DataFrame, spec: RollupSpec, tier: str = "minute") -> DataFrame:
    """(keys, bin, n): the 39 bins in long form."""
    return durations(df, spec, tier).groupBy(*spec.key_columns(), histogram.bin_of(F.col("duration")).alias("bin")).agg(F.count("*").alias("n"))


def histogram_wide(df: DataFrame, spec: RollupSpec, tier: str = "minute") -> DataFrame:
    """(keys, hist_00 ... hist_38)."""
    binned = durations(df, spec, tier).withColumn("bin", histogram.bin_of(F.col("duration")))
    return binned.groupBy(*spec.key_columns()).agg(*[F.count_if(F.col("bin") == i).alias(f"hist_{i:02d}") for i in range(histogram.BINS)])


def sketch_rows(df: DataFrame, spec: RollupSpec, tier: str = "minute") -> DataFrame:
    """(keys, idx, cnt): the duration sketch in long form."""
    return sketch.add(durations(df, spec, tier), spec.key_columns())


def average(rollup: DataFrame, spec: RollupSpec, keys: list[str]) -> DataFrame:
    """Mean duration over the spec's own denominator; null without samples."""
    return rollup.groupBy(*keys).agg(F.sum("total_duration").alias("t"), F.sum(spec.average_over).alias("n")).select(*keys, F.round(F.col("t") / F.nullif("n", F.lit(0)), 6).alias("avg_duration"))


def aggregate_sql(spec: RollupSpec, source: str, tier: str = "minute") -> str:
    """The same rollup straight from raw records, for the oracle."""
    keys = [f"{e} as k_{k}" for k, e in spec.keys.items()] + [f"date_trunc('{tier}', created_at) as k_bucket_start", "coalesce(environment, '') as k_environment"]
    cols = ["count(*) as call_count"] + [f"cast(sum(case when {p} then 1 else 0 end) as bigint) as {c}" for c, p in spec.counters.items()]
    if spec.has_duration:
        cols += [f"cast(coalesce(sum(duration) filter (where {spec.duration_where}), 0) as bigint) as total_duration", f"min(duration) filter (where {spec.duration_where}) as min_duration", f"max(duration) filter (where {spec.duration_where}) as max_duration"]
    if spec.has_duration_count:
        cols.append(f"count(duration) filter (where {spec.duration_where}) as duration_count")
    cols += [f"min({e}) as {c}" for c, e in spec.representatives.items()]
    names = [f"k_{k} as {k}" for k in spec.key_columns()]
    inner = f"select *, {', '.join(keys)} from {source} r"
    group = ", ".join(f"k_{k}" for k in spec.key_columns())
    return f"select {', '.join(names)}, {', '.join(cols)} from ({inner}) g group by {group}"


def long_sql(spec: RollupSpec, source: str, expr: str, name: str, count: str, tier: str = "minute") -> str:
    keys = [f"{e} as k_{k}" for k, e in spec.keys.items()] + [f"date_trunc('{tier}', created_at) as k_bucket_start", "coalesce(environment, '') as k_environment"]
    group = ", ".join(f"k_{k}" for k in spec.key_columns())
    inner = f"select {', '.join(keys)}, {expr} as {name} from {source} r where {spec.duration_where} and duration is not null"
    return f"select {', '.join(f'k_{k} as {k}' for k in spec.key_columns())}, {name}, count(*) as {count} from ({inner}) g group by {group}, {name}"
