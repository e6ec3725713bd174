"""Health diagnosis: rules over a metrics row, lifecycle, score and reduction."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.operators import windows

#: (code, level, SQL condition over the metrics columns). Fixed thresholds.
RULES = (
    ("DRAIN_UNREACHABLE", "critical", "conn_fail_at > ok_at and last_error is not null and now - conn_fail_at < 45"),
    ("DRAIN_WEDGED", "critical", "worker_stale_s > 180"),
    ("DRAIN_WRITE_FAILING", "critical", "error_at > ok_at and error_at >= conn_fail_at"),
    ("DRAIN_STOPPED", "critical", "drain_rate = 0 and pending > 100 and not (conn_fail_at > ok_at) and worker_stale_s <= 180 and not (error_at > ok_at)"),
    ("DRAIN_QUARANTINE", "critical", "quarantined_total > 0"),
    ("ROLLUP_REPAIR_PENDING", "warning", "repair_debt > 0"),
    ("ROLLUP_STALE", "critical", "stale_rollups > 0"),
    ("ROLLUP_BACKFILL_PENDING", "info", "backfill_age_s between 0 and 21600"),
    ("ROLLUP_BACKFILL_PENDING", "warning", "backfill_age_s > 21600"),
    ("DRAIN_FALLING_BEHIND", "warning", "ingest_rate > 1.5 * drain_rate and pending > 5000"),
    ("BACKLOG_HIGH", "warning", "pending > 0.5 * max_pending and pending <= 0.8 * max_pending"),
    ("BACKLOG_CRITICAL", "critical", "pending > 0.8 * max_pending"),
    ("BACK_PRESSURE_ACTIVE", "critical", "back_pressure"),
    ("PG_LATENCY_HIGH", "warning", "pg_latency_ms > 500 and pg_latency_ms <= 2000"),
    ("PG_LATENCY_CRITICAL", "critical", "pg_latency_ms > 2000"),
    ("DRAIN_ERRORS", "warning", "failed_batches / greatest(drained_rows / 1000.0 + failed_batches, 1) > 0.1 and not (error_at > ok_at)"),
    ("LOOP_LAG_HIGH", "warning", "loop_lag_ms > 50 and loop_lag_ms <= 200"),
    ("LOOP_LAG_CRITICAL", "critical", "loop_lag_ms > 200"),
    ("WAL_LARGE", "warning", "wal_mb > 100"),
    ("DRAIN_METRICS_STALE", "warning", "metrics_age_s > 15"),
    ("MEMORY_HIGH", "warning", "rss_share > 0.7"),
    ("REJECT_RATE_HIGH", "warning", "reject_rate > 0.02 and reject_rate <= 0.1"),
    ("REJECT_RATE_CRITICAL", "critical", "reject_rate > 0.1"),
    ("CPU_HIGH", "warning", "cpu > 70 and cpu <= 90"),
    ("CPU_SATURATION", "critical", "cpu > 90"),
    ("SYSTEM_MEMORY_HIGH", "warning", "memory > 75 and memory <= 90"),
    ("SYSTEM_MEMORY_CRITICAL", "critical", "memory > 90"),
)
PENALTY = {"critical": 25, "warning": 10, "info": 2}
METRICS = ("now conn_fail_at ok_at error_at last_error worker_stale_s drain_rate ingest_rate pending max_pending quarantined_total repair_debt stale_rollups backfill_age_s back_pressure "
           "pg_latency_ms failed_batches drained_rows loop_lag_ms wal_mb metrics_age_s rss_share reject_rate cpu memory").split()  # fmt: skip


def diagnose(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, level) of every rule that holds; a null measure breaks none."""
    found = F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for code, level, c in RULES])
    return metrics.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("d")).select(*keys, "d.*")


def diagnose_sql(metrics: str, keys: str) -> str:
    return " union all ".join(f"select {keys}, '{code}' as code, '{level}' as level from {metrics} m where {c}" for code, level, c in RULES)


def score(diagnoses: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """100 less the penalties, 0 at least, and its band, for each subject."""
    cost = F.coalesce(F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv])[F.col("level")], F.lit(0))
    lost = diagnoses.groupBy(*keys).agg(F.sum(cost).alias("lost"))
    s = F.greatest(100 - F.coalesce("lost", F.lit(0)), F.lit(0))
    return subjects.select(*keys).join(lost, keys, "left").select(*keys, s.cast("long").alias("score"), F.when(s >= 80, "healthy").when(s >= 40, "degraded").otherwise("critical").alias("band"))


def lifecycle(diagnosed: DataFrame, keys: list[str], tick: str, debounce: int = 2, resolvable: int = 3, now_tick: int | None = None, kept: int = 300) -> DataFrame:
    """Runs of consecutive ticks per code: alerted after `debounce`, resolved notes after `resolvable`.

    With now_tick, runs that ended over `kept` ticks before it are forgotten.
    """
    runs = windows.islands(diagnosed.select(*keys, "code", tick).distinct(), [*keys, "code"], tick)
    if now_tick is not None:
        runs = runs.where(F.lit(now_tick) - F.col("last_tick") <= kept)
    return runs.select(*keys, "code", "first_tick", "last_tick", "ticks", (F.col("ticks") >= debounce).alias("alerted"), (F.col("ticks") >= resolvable).alias("resolves"))


def reduce_workers(workers: DataFrame) -> DataFrame:
    """One row of all workers: sums, largest gauges, newest error, mean positive latency."""
    return workers.agg(
        F.sum("drained").alias("drained"), F.max("open_issues").alias("open_issues"), F.max_by("last_error", F.struct("error_at", "worker")).alias("last_error"), F.min("floor").alias("floor"),
        F.max("staleness").alias("staleness"), F.round(F.avg(F.when(F.col("latency") > 0, F.col("latency"))), 6).alias("latency"), F.min("updated_at").alias("updated_at"),
    )


def alertable(diagnoses: DataFrame) -> DataFrame:
    return diagnoses.where("level <> 'info'")


def worst_wedge(workers: DataFrame) -> DataFrame:
    """(worker, stale_s, phase) of the worker blocked longest in one call; of ties the first; none if none is blocked."""
    return workers.where("stale_s > 0").orderBy(F.desc("stale_s"), "worker").select("worker", "stale_s", "phase").limit(1)


def cpu_usage(samples: DataFrame, keys: list[str], order: str) -> DataFrame:
    """samples of cumulated total and idle CPU ticks with usage_pct since the one before, to one decimal; 0 without progress, null at first."""
    w = Window.partitionBy(*keys).orderBy(order)
    total, idle = F.col("total") - F.lag("total").over(w), F.col("idle") - F.lag("idle").over(w)
    return samples.withColumn("usage_pct", F.when(total > 0, F.round((1 - idle / total) * 100, 1)).when(total.isNotNull(), 0.0))


def memory_usage(total: Column, available: Column) -> Column:
    return F.when(total > 0, F.round((1 - available / total) * 100, 1)).otherwise(0.0)


def host_sample(root: str = "/proc") -> dict:
    """One sample of this machine's counters: cumulated and idle CPU ticks, memory in bytes, load; what cannot be read is missing."""
    out: dict = {}
    try:
        ticks = [int(x) for x in Path(root, "stat").read_text().split("\n", 1)[0].split()[1:8]]
        out |= {"total": sum(ticks), "idle": ticks[3]}
    except (OSError, ValueError, IndexError):
        pass
    try:
        memory = dict(line.split(":", 1) for line in Path(root, "meminfo").read_text().splitlines() if ":" in line)
        out |= {"memory_total": int(memory["MemTotal"].split()[0]) * 1024, "memory_available": int(memory["MemAvailable"].split()[0]) * 1024}
    except (OSError, ValueError, KeyError):
        pass
    try:
        out["load"] = [float(x) for x in Path(root, "loadavg").read_text().split()[:3]]
    except (OSError, ValueError):
        pass
    return out


def report(metrics: DataFrame, diagnoses: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, report): one JSON health document each, with its diagnoses by code."""
    listed = diagnoses.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("code", "level"))).alias("diagnoses"))
    pct = lambda part, whole, most: F.when(whole > 0, F.round(F.least(part / whole * 100, F.lit(most)), 2)).otherwise(0.0)
    rates = F.col("ingest_rate") + F.col("rejected_rate")
    joined = metrics.withColumn("rejected_rate", F.col("reject_rate") * F.col("ingest_rate")).join(scores, keys).join(listed, keys, "left")
    empty = F.expr("cast(array() as array<struct<code: string, level: string>>)")
    document = F.struct(
        F.lit(1).alias("version"), F.col("band").alias("status"), F.col("score").alias("health_score"),
        F.struct(F.col("ingest_rate").alias("rate_1m"), pct(F.col("rejected_rate"), rates, 100.0).alias("reject_pct")).alias("ingest"),
        F.struct(F.col("drain_rate").alias("rate_1m"), F.col("failed_batches").alias("batches_failed"), F.col("pg_latency_ms"), (F.col("metrics_age_s") > 15).alias("metrics_stale")).alias("drain"),
        F.struct(F.col("pending").alias("pending_rows"), F.col("max_pending").alias("max_pending_rows"), pct(F.col("pending"), F.col("max_pending"), 999.99).alias("utilization_pct"), F.col("back_pressure").alias("back_pressure_active")).alias("buffer"),
        F.struct(F.col("cpu").alias("cpu_usage_pct"), F.col("memory").alias("memory_used_pct")).alias("system"), F.coalesce("diagnoses", empty).alias("diagnoses"),
    )
    return joined.select(*keys, F.to_json(document).alias("report"))


def alert_payload(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Alerts as JSON documents, ready for a sink that posts them."""
    return rows.select(F.to_json(F.struct(*columns)).alias("payload"))


def for_channels(events: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel, event rows) of enabled channels that ask for the event; a null list asks for all."""
    wanted = channels.where("enabled").select("channel", F.from_json("config", "notify_events array<string>").getField("notify_events").alias("wants"))
    # a row for each event name that a channel takes, so that the join is an equality
    names = events.select("event").distinct()
    takes = wanted.where("wants is not null").select("channel", F.explode(F.array_distinct("wants")).alias("event"))
    every = wanted.where("wants is null").groupBy().agg(F.collect_list("channel").alias("channels"))
    to_all = names.withColumn("_k", F.lit(1)).join(every.withColumn("_k", F.lit(1)), "_k").select(F.explode("channels").alias("channel"), "event")
    return events.join(takes.join(names, "event", "left_semi").select("channel", "event").unionAll(to_all), "event")


def backoff(interval: Column, streak: Column, most: float = 10.0) -> Column:
    return F.least(interval * F.pow(F.lit(2.0), F.least(streak - 1, F.lit(20))), F.lit(most))


def next_window(current: Column, elapsed: Column, least: float, most: float) -> Column:
    """Pacing: scale a work window towards one second a step."""
    return F.greatest(F.least(current * F.greatest(F.least(1 / elapsed, F.lit(2.0)), F.lit(0.25)), F.lit(most)), F.lit(least))
