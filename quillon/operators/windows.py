"""Ordered computations: concurrency, streaks, lifecycles, averages, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MINUTE = 60_000_000
DAY_S = 86_400


def concurrency(spans: DataFrame, low_us: int, high_us: int, now_us: int, margin_us: int = 900_000_000) -> DataFrame:
    """(bucket, delta_sum, max_prefix) for minutes of [low, high).

    +1 at a start, -1 at its end; ends beyond a day ahead of now and negative
    or null durations are left out, and starts are read from a margin before
    low. Within a minute starts come before ends of the same instant. Windows
    are by minute, so no task holds more than one minute's events.
    """
    s = spans.where((F.col("duration") >= 0) & F.col("ts_us").between(low_us - margin_us, high_us - 1) & (F.col("ts_us") + F.col("duration") <= now_us + DAY_S * 1_000_000))
    marks = s.select(F.explode(F.array(F.struct(F.col("ts_us").alias("ts"), F.lit(1).alias("d")), F.struct((F.col("ts_us") + F.col("duration")).alias("ts"), F.lit(-1).alias("d")))).alias("m")).select("m.*")
    marks = marks.withColumn("bucket", F.floor(F.col("ts") / MINUTE) * MINUTE).where(F.col("bucket").between(low_us, high_us - 1))
    marks = marks.groupBy("bucket", "ts", "d").agg(F.sum("d").alias("d_sum"))  # equal marks fold before the sort
    w = Window.partitionBy("bucket").orderBy("ts", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    run = marks.withColumn("run", F.sum("d_sum").over(w))
    return run.groupBy("bucket").agg(F.sum("d_sum").alias("delta_sum"), F.greatest(F.max("run"), F.lit(0).cast("long")).alias("max_prefix"))


def peaks(rollup: DataFrame, group_us: int = 3600 * 1_000_000) -> DataFrame:
    """(bucket, peak): concurrency carried across minutes.

    Minutes are prefix-summed within groups of an hour, and the hours' totals
    among themselves, so that only a row an hour meets in one task.
    """
    grouped = rollup.withColumn("g", F.floor(F.col("bucket") / group_us))
    totals = grouped.groupBy("g").agg(F.sum("delta_sum").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = grouped.join(totals.select("g", before.alias("carry")), "g")
    own = F.coalesce(F.sum("delta_sum").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return carried.select("bucket", (F.col("carry") + own + F.col("max_prefix")).alias("peak"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def streaks(minutes: DataFrame, value: str, threshold: float, length: int, keys: list[str]) -> DataFrame:
    """(keys, bucket) of minutes that end `length` consecutive ones at or above.

    Missing minutes break a streak, by the range of the frame in seconds.
    """
    at = F.unix_micros(F.col("bucket_start").cast("timestamp")) / F.lit(MINUTE)
    w = Window.partitionBy(*keys).orderBy(at.cast("long")).rangeBetween(-(length - 1), 0)
    hit = minutes.withColumn("hit", (F.col(value) >= threshold).cast("int"))
    return hit.withColumn("run", F.sum("hit").over(w)).where(F.col("run") == length).select(*keys, "bucket_start")


def islands(ticks: DataFrame, keys: list[str], tick: str) -> DataFrame:
    """(keys, first, last, ticks) of each run of consecutive ticks, for lifecycles."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(tick))
    return ticks.withColumn("g", F.col(tick) - n).groupBy(*keys, "g").agg(F.min(tick).alias("first_tick"), F.max(tick).alias("last_tick"), F.count("*").alias("ticks")).drop("g")


def ewma(df: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.3, block: int = 4096) -> DataFrame:
    """(keys, ewma): exponentially weighted mean, seeded by the first value.

    The mean is a weighted sum of the values, by how many come after each, so
    that blocks of the order (block values of an integer order column each)
    fold on their own and their sums combine; no task holds a whole key.
    """
    blocked = df.where(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col(order) / block))
    own = Window.partitionBy(*keys, "_b").orderBy(F.desc(order))
    ranked = blocked.withColumn("_r", F.row_number().over(own) - 1)  # values after it in its block
    keep = F.lit(1 - alpha)
    folded = ranked.groupBy(*keys, "_b").agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double") * F.pow(keep, F.col("_r"))).alias("s"), F.min_by(F.col(value).cast("double"), order).alias("v0"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_b"))
    placed = folded.withColumn("after", F.coalesce(F.sum("n").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = placed.groupBy(*keys).agg(F.sum(F.col("s") * F.pow(keep, F.col("after"))).alias("s"), F.sum("n").alias("n"), F.min_by("v0", "_b").alias("v0"))
    # the first value's weight is (1 - alpha) ** (n - 1), not alpha times that
    return total.select(*keys, (F.lit(alpha) * F.col("s") + keep * F.pow(keep, F.col("n") - 1) * F.col("v0")).alias("ewma"))


def ring_average(df: DataFrame, keys: list[str], second: str, value: str, slots: int = 60) -> DataFrame:
    """Mean over a ring of one-second slots; empty slots count as 0."""
    w = Window.partitionBy(*keys).orderBy(second).rangeBetween(-(slots - 1), 0)
    return df.withColumn("ring_avg", F.sum(value).over(w) / F.lit(slots))


def rates(df: DataFrame, keys: list[str], order: str, counter: str, block: int = 65_536) -> DataFrame:
    """df with delta, the increase of a counter since the row before; a reset counts as 0.

    Rows are ordered within blocks of an integer order column; a block's first
    row meets the last counter of the key's block before, so that a key with
    many rows is not one task's.
    """
    blocked = df.withColumn("_b", F.floor(F.col(order) / block))
    ends = blocked.groupBy(*keys, "_b").agg(F.max_by(counter, order).alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), "_before")
    same = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = blocked.join(ends, same, "left").select(*df.columns, "_b", "_before")
    before = F.coalesce(F.lag(counter).over(Window.partitionBy(*keys, "_b").orderBy(order)), F.col("_before"))
    return joined.withColumn("delta", F.greatest(F.col(counter) - before, F.lit(0))).drop("_b", "_before")


TOLERANCE_S = {"daily": 3 * DAY_S, "hourly": 3 * 3600, "minute": 900}


def tier_of(name: Column) -> Column:
    return F.when(name.endswith("_daily_rollups"), "daily").when(name.endswith("_hourly_rollups"), "hourly").otherwise("minute")


def stale(tables: DataFrame) -> DataFrame:
    """(name, behind) of rollup tables behind their tier's leader beyond tolerance.

    tables has (name, max_bucket in seconds or null); empty tables and tables
    without peers in their tier are silent.
    """
    t = tables.where(F.col("name").endswith("_rollups") & F.col("max_bucket").isNotNull()).withColumn("tier", tier_of(F.col("name")))
    lead = t.groupBy("tier").agg(F.max("max_bucket").alias("top"), F.count("*").alias("peers"))
    limit = F.create_map(*[F.lit(x) for kv in TOLERANCE_S.items() for x in kv])[F.col("tier")]
    return t.join(F.broadcast(lead), "tier").withColumn("behind", F.col("top") - F.col("max_bucket")).where((F.col("peers") > 1) & (F.col("behind") > limit)).select("name", "behind").orderBy(F.desc("behind"), "name")
