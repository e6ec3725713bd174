"""Issues: grouping, thresholds, saturation, and the resolve/reopen lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillon.operators import windows

ISSUE_KEYS = ["group_hash", "type", "environment"]


def fingerprint(cls: Column, code: Column, file: Column, line: Column, group: Column | None = None) -> Column:
    """The given group unless it is missing, '' or '0'; else md5 of the four parts."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (cls, code, file, line)]
    own = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return own if group is None else F.when(group.isNull() | group.isin("", "0"), own).otherwise(group)


def exception_groups(exceptions: DataFrame) -> DataFrame:
    """Occurrences, distinct users ('' and '0' count as none), times, first class, last message."""
    user = F.when(~F.col("user_id").isin("", "0"), F.col("user_id"))
    return exceptions.groupBy(F.col("fingerprint").alias("group_hash"), F.coalesce("environment", F.lit("")).alias("environment")).agg(
        F.count("*").alias("occurrences"), F.countDistinct(user).alias("users_count"), F.min("ts_us").alias("first_seen"), F.max("ts_us").alias("last_seen"),
        F.min_by("class", F.struct("ts_us", "id")).alias("class"), F.max_by("message", F.struct("ts_us", "id")).alias("message"),
    )


def threshold_of(records: DataFrame, thresholds: DataFrame, kind: str) -> DataFrame:
    """records with threshold_us: the exact target's, else the kind's global one.

    thresholds has (seq, type, target or null, duration_ms); the last of equal
    ones wins. It is a settings table; its rows are reduced to one a target.
    """
    own = thresholds.where(F.col("type") == kind).groupBy("target").agg((F.max_by("duration_ms", "seq") * 1000).alias("us"))
    exact = own.where("target is not null").withColumnRenamed("us", "exact_us")
    general = own.where("target is null").agg(F.max("us").alias("general_us"))
    # one row of settings; the constant key makes it an equality, so no rows are crossed
    joined = records.join(exact, "target", "left").withColumn("_all", F.lit(1)).join(general.withColumn("_all", F.lit(1)), "_all", "left").drop("_all")
    return joined.withColumn("threshold_us", F.coalesce("exact_us", "general_us")).drop("exact_us", "general_us")


def performance_groups(timed: DataFrame) -> DataFrame:
    """Records at or above their threshold, grouped; an empty group falls to md5(target)."""
    key = F.when(F.coalesce("group_hash", F.lit("")) == "", F.md5(F.col("target").cast("binary"))).otherwise(F.col("group_hash"))
    user = F.when(~F.col("user_id").isin("", "0"), F.col("user_id"))
    over = timed.where("duration >= threshold_us")
    return over.groupBy(key.alias("group_hash"), F.coalesce("environment", F.lit("")).alias("environment")).agg(
        F.count("*").alias("occurrences"), F.max("duration").alias("triggered_us"), F.max("threshold_us").alias("threshold_us"),
        F.countDistinct(user).alias("users_count"), F.min("ts_us").alias("first_seen"), F.max("ts_us").alias("last_seen"),
    )


def resolved_at(activity: DataFrame) -> DataFrame:
    """(issue_id, resolved_at): the last time each issue's status became resolved."""
    return activity.where("action = 'status_changed' and new_value = 'resolved'").groupBy("issue_id").agg(F.max("created_at").alias("resolved_at"))


def classify(groups: DataFrame, issues: DataFrame, activity: DataFrame, now: int, cooldown: int) -> DataFrame:
    """groups with state new, existing, reopen or cooling, by the stored issue.

    Resolved issues reopen when max(0, now - resolved_at) reaches the cooldown,
    or when no resolve activity is known; ignored and open ones are existing.
    """
    known = issues.join(resolved_at(activity), "issue_id", "left").select(*ISSUE_KEYS, "issue_id", "status", "resolved_at")
    age = F.greatest(F.lit(now) - F.col("resolved_at"), F.lit(0))
    state = F.when(F.col("issue_id").isNull(), "new").when(F.col("status") != "resolved", "existing").when(F.col("resolved_at").isNull() | (age >= cooldown), "reopen").otherwise("cooling")
    return groups.join(known, ISSUE_KEYS, "left").withColumn("state", state)


def upsert(issues: DataFrame, classified: DataFrame) -> DataFrame:
    """Exception issues after a batch: counts add, first_seen and class stay,
    last_seen grows, the users' exact count and the message are the batch's.
    Status returns to open only for reopened issues."""
    j, status = _folded(issues, classified, ["class", "message"])
    return j.select(*ISSUE_KEYS, status, *_counts(F.coalesce("users_count", "old_users_count")), F.coalesce("old_class", "class").alias("class"), F.coalesce("message", "old_message").alias("message"))


def upsert_performance(issues: DataFrame, classified: DataFrame) -> DataFrame:
    """Performance issues after a batch, as upsert() but for the larger users'
    count, the batch's threshold, if it has one, and the longest duration."""
    j, status = _folded(issues, classified, ["threshold_ms", "triggered_ms"])
    zero = F.lit(0).cast("long")
    return j.select(
        *ISSUE_KEYS, status, *_counts(F.greatest("users_count", "old_users_count")), F.coalesce("threshold_ms", "old_threshold_ms").alias("threshold_ms"),
        F.greatest(F.coalesce("old_triggered_ms", zero), F.coalesce("triggered_ms", zero)).alias("triggered_ms"),
    )


def _folded(issues: DataFrame, classified: DataFrame, more: list[str]) -> tuple[DataFrame, Column]:
    old = issues.select(*ISSUE_KEYS, *[F.col(c).alias(f"old_{c}") for c in ("status", "occurrences", "users_count", "first_seen", "last_seen", *more)])
    new = classified.select(*ISSUE_KEYS, "occurrences", "users_count", "first_seen", "last_seen", "state", *more)
    status = F.when(F.col("old_status").isNull() | (F.col("state") == "reopen"), "open").otherwise(F.col("old_status"))
    return old.join(new, ISSUE_KEYS, "full_outer"), status.alias("status")


def _counts(users: Column) -> list[Column]:
    zero = F.lit(0)
    return [
        (F.coalesce("old_occurrences", zero) + F.coalesce("occurrences", zero)).alias("occurrences"), users.alias("users_count"),
        F.coalesce("old_first_seen", "first_seen").alias("first_seen"), F.greatest("old_last_seen", "last_seen").alias("last_seen"),
    ]


def reopened_activity(issues: DataFrame, classified: DataFrame, now: int) -> DataFrame:
    """Activity rows for reopened issues that are open after the upsert."""
    reopened = classified.where("state = 'reopen'").select(*ISSUE_KEYS)
    changed = [F.lit(v).alias(c) for c, v in (("actor_type", "agent"), ("action", "status_changed"), ("old_value", "resolved"), ("new_value", "open"))]
    return issues.where("status = 'open'").join(reopened, ISSUE_KEYS, "left_semi").select(*ISSUE_KEYS, *changed, F.lit(now).cast("long").alias("created_at"))


def fresh_alerts(classified: DataFrame, issues: DataFrame) -> DataFrame:
    """New groups (neither known nor reopened), with what the issues after the upsert say of them."""
    stored = issues.select(*ISSUE_KEYS, *[F.col(c).alias(f"issue_{c}") for c in ("status", "occurrences", "users_count", "first_seen", "last_seen")])
    return classified.where("state = 'new'").join(stored, ISSUE_KEYS, "left")


def dedupe(issues: DataFrame) -> DataFrame:
    """One issue for each key: the last seen, then the largest id."""
    return windows.latest(issues, ISSUE_KEYS, F.desc_nulls_last("last_seen"), F.desc("issue_id"))


def saturation(minutes: DataFrame, workers: int, percent: int, length: int, now_bucket) -> DataFrame:
    """Minutes that end a streak of busy workers; the current minute is left out.

    minutes has (environment, bucket_start, total_duration in microseconds);
    the bar is ceil(workers * percent / 100 * 60 s), reached inclusively.
    """
    if not (10 <= percent <= 200 and 1 <= length <= 60 and workers > 0):
        raise ValueError("percent is 10 to 200, length 1 to 60, workers positive")
    bar = -(-workers * percent * windows.MINUTE // 100)
    return windows.streaks(minutes.where(F.col("bucket_start") < now_bucket), "total_duration", bar, length, ["environment"])
