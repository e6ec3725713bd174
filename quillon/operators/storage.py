"""Dictionaries, storage families, retention, repair and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dictionary(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, kind, value) of every distinct value; a hash is the id, so parallel
    batches agree without a sequence. known entries stay as they are."""
    fresh = values.select("kind", "value").where("value is not null").distinct()
    if known is not None:
        fresh = fresh.join(known, ["kind", "value"], "left_anti")
    coded = fresh.select(F.md5(F.concat_ws("\0", "kind", "value").cast("binary")).alias("id"), "kind", "value")
    return coded if known is None else known.select("id", "kind", "value").unionByName(coded)


def encode(df: DataFrame, entries: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replaces each column by the id of its value; unknown values become null."""
    for column, kind in columns.items():
        own = entries.where(F.col("kind") == kind).select(F.col("value").alias(column), F.col("id").alias("_id"))
        df = df.join(own, column, "left").drop(column).withColumnRenamed("_id", column)
    return df


def decode(df: DataFrame, entries: DataFrame, columns: dict[str, str]) -> DataFrame:
    for column, kind in columns.items():
        own = entries.where(F.col("kind") == kind).select(F.col("id").alias(column), F.col("value").alias("_value"))
        df = df.join(own, column, "left").drop(column).withColumnRenamed("_value", column)
    return df


#: Columns that the second family stores as dictionary ids, by kind of value.
CODED = {
    "requests": {"route_path": "route", "url": "url"}, "queries": {"sql_query": "sql", "connection": "connection"}, "jobs": {"job_class": "job", "queue": "queue"}, "exceptions": {"class": "class"},
    "commands": {"command": "command"}, "scheduled": {"command": "command"}, "cache_events": {"key": "key", "store": "store"}, "mail": {"mailable": "mailable"}, "notifications": {"notification": "notification", "channel": "channel"},
}


def collect_values(df: DataFrame, kind: str) -> DataFrame:
    """Distinct (kind, value) of the columns of a record kind that are coded."""
    pairs = [F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for c, k in CODED.get(kind, {}).items() if c in df.columns]
    if not pairs:
        return df.sparkSession.createDataFrame([], "kind string, value string")
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").where("value is not null").distinct()


def to_v2(df: DataFrame, kind: str, entries: DataFrame) -> DataFrame:
    """Rows of the first family in the second's types: ids for coded values,
    hashes as bytes, time in microseconds, a trace only where it adds something."""
    own = {c: k for c, k in CODED.get(kind, {}).items() if c in df.columns}
    out = encode(df, entries, own)
    if {"trace_id", "execution_id"} <= set(df.columns):
        out = dedupe_trace(out)
    for c in {"group_hash", "fingerprint"} & set(df.columns):
        out = out.withColumn(c, F.unhex(c))
    return out.withColumn("ts_us", F.unix_micros(F.col("created_at").cast("timestamp"))).drop("created_at")


def from_v2(df: DataFrame, kind: str, entries: DataFrame) -> DataFrame:
    """The first family's rows again."""
    own = {c: k for c, k in CODED.get(kind, {}).items() if c in df.columns}
    out = decode(df, entries, own)
    if {"trace_id", "execution_id"} <= set(df.columns):
        out = restore_trace(out)
    for c in {"group_hash", "fingerprint"} & set(df.columns):
        out = out.withColumn(c, F.lower(F.hex(c)))
    return out.withColumn("created_at", F.timestamp_micros("ts_us").cast("timestamp_ntz"))


def both_families(first: DataFrame | None, second: DataFrame | None) -> DataFrame:
    """Rows of the storage families that exist; filters push into each arm."""
    arms = [d for d in (first, second) if d is not None]
    return arms[0] if len(arms) == 1 else arms[0].unionByName(arms[1], allowMissingColumns=True)


def dedupe_trace(df: DataFrame) -> DataFrame:
    """trace_id is null where it equals execution_id, whatever the case."""
    return df.withColumn("trace_id", F.when(F.lower("trace_id") != F.lower("execution_id"), F.col("trace_id")).when(F.col("execution_id").isNull(), F.col("trace_id")))


def restore_trace(df: DataFrame) -> DataFrame:
    return df.withColumn("trace_id", F.coalesce("trace_id", "execution_id"))


def retained(df: DataFrame, now, days: int, column: str = "created_at") -> DataFrame:
    """Rows younger than the window; a partition filter where data is laid out by day."""
    return df.where(F.col(column) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


#: Days that each kind of table is kept.
KEEP_DAYS = {"raw": 14, "minute": 90, "hour": 366, "day": 1100}


def cutoff(now, kind: str = "raw", hours: int | None = None, keep_days: dict[str, int] = KEEP_DAYS) -> Column:
    """Rows before this instant go; hours, one at least, win over days for raw rows."""
    span = f"{max(1, hours)} hours" if hours is not None and kind == "raw" else f"{keep_days[kind]} days"
    return F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {span}")


def kept(df: DataFrame, now, kind: str = "raw", hours: int | None = None, keep_days: dict[str, int] = KEEP_DAYS) -> DataFrame:
    """Rows of a raw or rollup table that its retention window keeps; those at the cutoff stay."""
    return df.where(F.col("created_at" if kind == "raw" else "bucket_start") >= cutoff(now, kind, hours, keep_days))


def expired_days(days: DataFrame, now, keep_days: int) -> DataFrame:
    """Day partitions whose end is at or before the cutoff."""
    return days.where(F.date_add("day", 1) <= F.date_sub(F.lit(now).cast("date"), keep_days))


def orphaned(entries: DataFrame, facts: DataFrame, key: str, cutoff) -> DataFrame:
    """Dictionary entries that no fact refers to and that are older than the cutoff."""
    return entries.where(F.col("created_at") < F.lit(cutoff).cast("timestamp_ntz")).join(facts.select(F.col(key)).distinct(), key, "left_anti")


def latest_users(users: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row a user: the newest name and email, and when it was first seen."""
    users = users.where("user_id is not null and user_id <> ''")
    if existing is not None:
        users = existing.unionByName(users, allowMissingColumns=True)
    return users.groupBy("user_id").agg(F.max(F.struct("seq", "name", "email")).alias("m"), F.min("seq").alias("first_seq")).select("user_id", "m.name", "m.email", "first_seq")


def bounds(df: DataFrame, column: str = "created_at") -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def completeness(raw: DataFrame, rollup: DataFrame, lag_seconds: int = 7200) -> DataFrame:
    """Why a minute rollup is incomplete against its raw rows: empty, head, tail or null."""
    a = bounds(raw).select(F.date_trunc("minute", "low").cast("timestamp_ntz").alias("raw_low"), "high").withColumnRenamed("high", "raw_high")
    b = bounds(rollup, "bucket_start").withColumnsRenamed({"low": "low", "high": "high"})
    gap = F.unix_micros(F.col("raw_high").cast("timestamp")) - F.unix_micros(F.col("high").cast("timestamp"))
    reason = F.when(F.col("raw_low").isNull(), None).when(F.col("low").isNull(), "empty").when(F.col("low") > F.col("raw_low"), "head").when(gap > lag_seconds * 1_000_000, "tail")
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").select(reason.alias("reason"))


def tier_gaps(fine: DataFrame, coarse: DataFrame, tier: str, keys: list[str], count: str = "call_count") -> DataFrame:
    """(keys, bucket_start, expected, stored) of coarse buckets that do not hold their finer rows' sum."""
    expected = fine.groupBy(*keys, F.date_trunc(tier, "bucket_start").cast("timestamp_ntz").alias("bucket_start")).agg(F.sum(count).alias("expected"))
    stored = coarse.select(*keys, "bucket_start", F.col(count).alias("stored"))
    return expected.join(stored, [*keys, "bucket_start"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("stored")))


def repair_plan(tables: DataFrame, now_s: int) -> DataFrame:
    """(table, action, since): what each table needs, in the order to do it.

    tables has (table, tier, reason, floor): a completeness reason or null, and
    the first skipped bucket or null. Minutes come before the tiers that are
    built from them; a skipped bucket is rebuilt from its floor on, an empty or
    headless table whole, a tail from the end on. now_s bounds the floor.
    """
    action = F.when(F.col("floor").isNotNull() & (F.col("floor") <= now_s), "rebuild").when(F.col("reason").isin("empty", "head"), "backfill").when(F.col("reason") == "tail", "extend")
    rank = F.when(F.col("tier") == "minute", 0).when(F.col("tier") == "hour", 1).otherwise(2)
    planned = tables.withColumn("action", action).where("action is not null")
    return planned.orderBy(rank, "table").select("table", "tier", "action", F.when(F.col("action") == "rebuild", F.col("floor")).alias("since"))


def repair_floor(skipped: DataFrame) -> DataFrame:
    """(table, floor): the first bucket from which each rollup must be rebuilt."""
    return skipped.groupBy("table").agg(F.min("bucket_start").alias("floor"))


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with the side that has them."""
    cols = a.columns
    return a.exceptAll(b.select(cols)).withColumn("side", F.lit("a")).unionAll(b.select(cols).exceptAll(a).withColumn("side", F.lit("b")))


def page_after(df: DataFrame, order: list[str], after: tuple | None, n: int) -> DataFrame:
    """Newest rows before a cursor, by the order columns descending."""
    if after is not None:
        df = df.where(F.struct(*order) < F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, after)]))
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def merge_signed(base: DataFrame, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """base plus signed deltas; groups whose count falls to 0 or below go."""
    return base.select(*keys, *sums).unionByName(delta.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(F.col(sums[0]) > 0)
