"""Concurrency, issues, joins, storage, health and read-side queries."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions import cachekey, scalars
from quillon.operators import health, issues, rollups, storage, windows
from quillon.sources import frames
from quillon.sources.adapters import records, records_sql

JAN = 1_704_067_200_000_000  # 2024-01-01 in microseconds
DAY = 86_400_000_000
NOW = JAN + 31 * DAY
S = records_sql
QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# --- windows -----------------------------------------------------------------

_MARKS = f"""
spans as (select ts_us, duration from {S('spans')} r where duration >= 0 and ts_us >= {JAN - 900_000_000} and ts_us < {NOW} and ts_us + duration <= {NOW + DAY}),
marks as (select ts_us as ts, 1 as d from spans union all select ts_us + duration, -1 from spans),
runs as (select cast(ts // 60000000 as bigint) * 60000000 as bucket, d, sum(d) over (partition by ts // 60000000 order by ts, d desc rows unbounded preceding) as run from marks),
conc as (select bucket, cast(sum(d) as bigint) as delta_sum, cast(greatest(max(run), 0) as bigint) as max_prefix from runs where bucket >= {JAN} and bucket < {NOW} group by bucket)"""


@query("w_conc", f"with {_MARKS} select * from conc")
def concurrency(spark, d):
    return windows.concurrency(records(spark, d, "spans"), JAN, NOW, NOW)


@query("w_peak", f"with {_MARKS} select bucket, cast(coalesce(sum(delta_sum) over (order by bucket rows between unbounded preceding and 1 preceding), 0) + max_prefix as bigint) as peak from conc")
def peak(spark, d):
    return windows.peaks(concurrency(spark, d))


@query("q_peak", f"with {_MARKS}, p as (select bucket, coalesce(sum(delta_sum) over (order by bucket rows between unbounded preceding and 1 preceding), 0) + max_prefix as peak from conc) select bucket // {DAY} * {DAY} as day_us, cast(max(peak) as bigint) as peak from p group by 1")
def daily_peak(spark, d):
    return peak(spark, d).groupBy((F.floor(F.col("bucket") / DAY) * DAY).alias("day_us")).agg(F.max("peak").alias("peak"))


_ISSUES = "(select o_orderkey as issue_id, md5(cast(o_custkey % 40 as string)) as group_hash, case when o_orderkey % 2 = 0 then 'exception' else 'performance' end as type, case o_orderkey % 3 when 0 then 'production' else '' end as environment, case when o_orderkey % 9 = 0 then null else {us} end as last_seen, case o_orderstatus when 'O' then 'open' when 'F' then 'resolved' else 'ignored' end as status, o_custkey % 6 as assigned from orders)"
_ISSUES_D = _ISSUES.format(us="epoch_us(o_orderdate)")


def stored_issues(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return spark.sql("select * from " + _ISSUES.format(us="unix_micros(cast(o_orderdate as timestamp))").replace("from orders", "from {orders}"), orders=orders)


@query("w_dedup", f"select issue_id, group_hash, type, environment, last_seen, status, assigned from (select *, row_number() over (partition by group_hash, type, environment order by last_seen desc nulls last, issue_id desc) as rn from {_ISSUES_D} i) where rn = 1")
def dedup(spark, d):
    return issues.dedupe(stored_issues(spark, d))


@query("a_open", f"select count(*) filter (where status = 'open') as open_issues from {_ISSUES_D} i")
def open_issues(spark, d):
    return stored_issues(spark, d).agg(F.count_if(F.col("status") == "open").alias("open_issues"))


@query("a_badge", f"select type, assigned, count(*) filter (where status = 'open') as open, count(*) filter (where status = 'resolved') as resolved, count(*) filter (where status = 'ignored') as ignored from {_ISSUES_D} i group by type, assigned")
def badges(spark, d):
    return stored_issues(spark, d).groupBy("type", "assigned").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("open", "resolved", "ignored")])


_OCC = f"(select coalesce(environment, '') as environment, date_trunc('hour', created_at) as bucket_start, cast(sum(duration) as bigint) as total_duration from {S('requests')} r group by all)"


@query("a_occ", f"select * from {_OCC} o")
def occupancy(spark, d):
    return records(spark, d, "requests").groupBy(F.coalesce("environment", F.lit("")).alias("environment"), F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("bucket_start")).agg(F.sum("duration").alias("total_duration"))


@query("w_streak", f"""with m as (select coalesce(environment, '') as environment, date_trunc('minute', created_at) as bucket_start, sum(duration) as t from {S('requests')} r group by all),
n as (select *, epoch_us(bucket_start) // 60000000 as k from m), h as (select *, count(*) filter (where t >= 20000) over (partition by environment order by k range between 1 preceding and current row) as run from n)
select environment, bucket_start from h where run = 2""")
def streak(spark, d):
    m = records(spark, d, "requests").groupBy(F.coalesce("environment", F.lit("")).alias("environment"), F.date_trunc("minute", "created_at").cast("timestamp_ntz").alias("bucket_start")).agg(F.sum("duration").alias("t"))
    return windows.streaks(m, "t", 20000, 2, ["environment"])


@query("i_sat", f"""with m as (select coalesce(environment, '') as environment, date_trunc('minute', created_at) as bucket_start, sum(duration) * 5000 as t from {S('requests')} r group by all),
n as (select *, epoch_us(bucket_start) // 60000000 as k from m), h as (select *, count(*) filter (where t >= 108000000) over (partition by environment order by k range between 1 preceding and current row) as run from n where bucket_start < timestamp '2024-01-31 00:00:00')
select environment, bucket_start from h where run = 2""")
def saturated(spark, d):
    m = records(spark, d, "requests").groupBy(F.coalesce("environment", F.lit("")).alias("environment"), F.date_trunc("minute", "created_at").cast("timestamp_ntz").alias("bucket_start")).agg((F.sum("duration") * 5000).alias("total_duration"))
    return issues.saturation(m, 2, 90, 2, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@query("w_ewma", """with recursive o as (select user_id, value, row_number() over (partition by user_id order by event_id) as n from events),
e as (select user_id, n, value as l from o where n = 1 union all select o.user_id, o.n, 0.3::double * o.value + 0.7::double * e.l from e join o on o.user_id = e.user_id and o.n = e.n + 1)
select user_id, round(max_by(l, n), 6) as ewma from e group by user_id""")
def ewma(spark, d):
    return windows.ewma(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("user_id", F.round("ewma", 6).alias("ewma"))


_SECONDS = "(select user_id % 4 as worker, epoch_us(ts) // 1000000 as second, count(*) as n from events group by 1, 2)"


def _seconds(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy((F.col("user_id") % 4).alias("worker"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("second")).agg(F.count("*").alias("n"))


@query("a_ring", f"select worker, second, round(sum(n) over (partition by worker order by second range between 59 preceding and current row) / 60.0::double, 6) as ring_avg from {_SECONDS} s")
def ring(spark, d):
    return windows.ring_average(_seconds(spark, d), ["worker"], "second", "n").select("worker", "second", F.round("ring_avg", 6).alias("ring_avg"))


@query("w_delta", "select event_id, greatest(user_id - lag(user_id) over (partition by event_type order by event_id), 0) as delta from events")
def deltas(spark, d):
    return windows.rates(spark.read.parquet(f"{d}/events.parquet").select("event_type", "event_id", "user_id"), ["event_type"], "event_id", "user_id").select("event_id", "delta")


_TICKS = f"(select distinct environment, status_code as code, epoch_us(created_at) // {DAY} as tick from {S('requests')} r where environment is not null and status_code = 500)"


@query("w_life", f"""with g as (select *, tick - row_number() over (partition by environment, code order by tick) as g from {_TICKS} t)
select environment, code, min(tick) as first_tick, max(tick) as last_tick, count(*) as ticks, count(*) >= 2 as alerted, count(*) >= 3 as resolves from g group by environment, code, g""")
def lifecycle(spark, d):
    t = records(spark, d, "requests").where("environment is not null and status_code = 500").select("environment", F.col("status_code").alias("code"), F.expr(f"ts_us div {DAY}").alias("tick"))
    return health.lifecycle(t, ["environment"], "tick")


_TABLES = "(select n_name || case n_nationkey % 3 when 0 then '_rollups' when 1 then '_hourly_rollups' else '_daily_rollups' end as name, case when n_nationkey % 8 = 0 then null else 1704067200 - n_nationkey * 20000 end as max_bucket from nation)"


@query("w_stale", f"""with t as (select *, case when name like '%\\_daily\\_rollups' escape '\\' then 259200 when name like '%\\_hourly\\_rollups' escape '\\' then 10800 else 900 end as tol from {_TABLES} x where max_bucket is not null)
select name, behind from (select name, tol, max(max_bucket) over (partition by tol) - max_bucket as behind, count(*) over (partition by tol) as peers from t) where peers > 1 and behind > tol""")
def stale(spark, d):
    return windows.stale(spark.sql("select * from " + _TABLES.replace("from nation", "from {nation}"), nation=spark.read.parquet(f"{d}/nation.parquet")))


# --- issues ------------------------------------------------------------------

_USER = "case when user_id not in ('', '0') then user_id end"
_GROUPS = f"(select fingerprint as group_hash, coalesce(environment, '') as environment, count(*) as occurrences, count(distinct {_USER}) as users_count, min(ts_us) as first_seen, max(ts_us) as last_seen, arg_min(class, (ts_us, id)) as class, arg_max(message, (ts_us, id)) as message from {S('exceptions')} r group by all)"


@query("a_iss", f"select * from {_GROUPS} g")
def exception_groups(spark, d):
    return issues.exception_groups(records(spark, d, "exceptions"))


@query("a_cd", f"select fingerprint, coalesce(environment, '') as environment, count(distinct user_id) as users from {S('exceptions')} r group by all")
def distinct_users(spark, d):
    """Exact distinct users over both storage families."""
    rows = records(spark, d, "exceptions")
    both = storage.both_families(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))
    return both.groupBy("fingerprint", F.coalesce("environment", F.lit("")).alias("environment")).agg(F.countDistinct("user_id").alias("users"))


@query("a_cdt", f"select count(*) as row_count, count(distinct (coalesce(key, ''), coalesce(store, ''), coalesce(environment, ''))) as groups from {S('cache_events')} r")
def distinct_tuples(spark, d):
    cols = [F.coalesce(c, F.lit("")) for c in ("key", "store", "environment")]
    return records(spark, d, "cache_events").agg(F.count("*").alias("row_count"), F.countDistinct(F.struct(*cols)).alias("groups"))


@query("a_setd", f"select environment, count(distinct user_id) as users from {S('requests')} r where user_id is not null group by 1")
def distinct_set(spark, d):
    return records(spark, d, "requests").where("user_id is not null").groupBy("environment").agg(F.countDistinct("user_id").alias("users"))


_KNOWN_D = f"(select cast('0x' || substr(md5(group_hash || '|' || environment), 1, 8) as bigint) as issue_id, group_hash, 'exception' as type, environment, case (occurrences + first_seen) % 3 when 0 then 'open' when 1 then 'resolved' else 'ignored' end as status, occurrences % 50 as occurrences, users_count, first_seen - 1000 as first_seen, last_seen - 5000 as last_seen, 'Old' || class as class, 'before' as message from {_GROUPS} g where first_seen % 4 <> 0)"


def known_issues(spark, d):
    """Stored issues derived from most of the groups, for the lifecycle queries."""
    g = exception_groups(spark, d).where("first_seen % 4 <> 0")
    status = F.expr("case (occurrences + first_seen) % 3 when 0 then 'open' when 1 then 'resolved' else 'ignored' end")
    return g.select(
        _issue_id("group_hash", "environment"), "group_hash", F.lit("exception").alias("type"), "environment", status.alias("status"), (F.col("occurrences") % 50).alias("occurrences"), "users_count",
        (F.col("first_seen") - 1000).alias("first_seen"), (F.col("last_seen") - 5000).alias("last_seen"), F.concat(F.lit("Old"), "class").alias("class"), F.lit("before").alias("message"),
    )


def _issue_id(*keys):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys).cast("binary")), 1, 8), 16, 10).cast("long").alias("issue_id")


_ACTIVITY_D = f"(select issue_id, 'status_changed' as action, 'resolved' as new_value, last_seen // 1000000 as created_at from {_KNOWN_D} k where status = 'resolved' and issue_id % 3 <> 0 union all select issue_id, 'status_changed', 'ignored', last_seen // 1000000 + 50 from {_KNOWN_D} k union all select issue_id, 'commented', null, last_seen // 1000000 + 99 from {_KNOWN_D} k)"
_COOL = 2 * 86_400
_SNAP = f"""(select g.*, k.issue_id, k.status, a.resolved_at, case when k.issue_id is null then 'new' when k.status <> 'resolved' then 'existing' when a.resolved_at is null or greatest({NOW // 1_000_000} - a.resolved_at, 0) >= {_COOL} then 'reopen' else 'cooling' end as state
from {_GROUPS} g left join {_KNOWN_D} k using (group_hash, environment) left join (select issue_id, max(created_at) as resolved_at from {_ACTIVITY_D} a where new_value = 'resolved' group by 1) a on a.issue_id = k.issue_id)"""


def activity(known):
    at = F.expr("last_seen div 1000000")
    changes = F.array(
        F.when(F.expr("status = 'resolved' and issue_id % 3 <> 0"), F.struct(F.lit("status_changed").alias("action"), F.lit("resolved").alias("new_value"), at.alias("created_at"))),
        F.struct(F.lit("status_changed").alias("action"), F.lit("ignored").alias("new_value"), (at + 50).alias("created_at")),
        F.struct(F.lit("commented").alias("action"), F.lit(None).cast("string").alias("new_value"), (at + 99).alias("created_at")),
    )
    return known.select("issue_id", F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select("issue_id", "c.*")


def _classified(spark, d):
    known = known_issues(spark, d)
    groups = exception_groups(spark, d).withColumn("type", F.lit("exception"))
    return known, issues.classify(groups, known, activity(known), NOW // 1_000_000, _COOL)


@query("i_snap", f"select group_hash, environment, issue_id, status, resolved_at, state from {_SNAP} s")
def snapshot(spark, d):
    return _classified(spark, d)[1].select("group_hash", "environment", "issue_id", "status", "resolved_at", "state")


@query("i_exc", f"""select s.group_hash, 'exception' as type, s.environment, case when s.status is null or s.state = 'reopen' then 'open' else s.status end as status, coalesce(k.occurrences, 0) + s.occurrences as occurrences, s.users_count, coalesce(k.first_seen, s.first_seen) as first_seen, greatest(k.last_seen, s.last_seen) as last_seen, coalesce(k.class, s.class) as class, s.message
from {_SNAP} s left join {_KNOWN_D} k using (issue_id)""")
def exception_issues(spark, d):
    return issues.upsert(*_classified(spark, d))


@query("i_act", f"select group_hash, 'exception' as type, environment, 'agent' as actor_type, 'status_changed' as action, 'resolved' as old_value, 'open' as new_value, cast({NOW // 1_000_000} as bigint) as created_at from {_SNAP} s where state = 'reopen'")
def reopen_activity(spark, d):
    known, c = _classified(spark, d)
    return issues.reopened_activity(issues.upsert(known, c), c, NOW // 1_000_000)


@query("i_queue", f"select group_hash, environment, class, message, 'open' as issue_status, occurrences as issue_occurrences, first_seen as issue_first_seen from {_SNAP} s where state = 'new'")
def queued_alerts(spark, d):
    """Groups that are neither known nor reopened, with what the stored issue says after the upsert."""
    known, c = _classified(spark, d)
    return issues.fresh_alerts(c, issues.upsert(known, c)).select("group_hash", "environment", "class", "message", "issue_status", "issue_occurrences", "issue_first_seen")


@query("j_scal", f"select issue_id, max(created_at) as resolved_at from {_ACTIVITY_D} a where new_value = 'resolved' group by 1")
def resolved(spark, d):
    return issues.resolved_at(activity(known_issues(spark, d)))


@query("j_latest", f"select fingerprint, environment, id, message from (select *, row_number() over (partition by fingerprint, environment order by ts_us desc, id desc) as rn from {S('exceptions')} r) where rn = 1")
def latest_exception(spark, d):
    newest = F.max_by(F.struct("id", "message"), F.struct("ts_us", "id"))
    return records(spark, d, "exceptions").groupBy("fingerprint", "environment").agg(newest.alias("m")).select("fingerprint", "environment", "m.*")


_FAMILIES = {
    "route": ("requests", "route_path"), "query": ("queries", "connection"), "job": ("jobs", "queue"), "command": ("commands", "command"), "scheduled_task": ("scheduled", "command"),
    "cache": ("cache_events", "store"), "mail": ("mail", "mailable"), "notification": ("notifications", "notification"), "outgoing_request": ("outgoing", "environment"),
}
_LIMITS = {"route": ("/error", 0.3, 0.2), "query": ("O", 40, 45), "job": ("1-URGENT", 4000, 3500), "command": ("cmd:5-LOW", 300, 350), "scheduled_task": ("cmd:2-HIGH", 300, 350), "cache": ("redis", 0.4, 0.2), "mail": ("Mail1", 300, 350), "notification": ("Note2", 300, 350), "outgoing_request": ("staging", 1, 2)}


def _thresholds(spark, family):
    target, own, general = _LIMITS[family]
    return spark.createDataFrame([(1, family, target, 1e9), (2, family, target, float(own)), (3, family, None, float(general))], "seq int, type string, target string, duration_ms double")


def over_threshold(spark, d, family):
    kind, target = _FAMILIES[family]
    rows = records(spark, d, kind)
    extra = {c: F.lit(None).cast(t) for c, t in (("group_hash", "string"), ("user_id", "string"), ("ts_us", "bigint")) if c not in rows.columns}
    timed = issues.threshold_of(rows.withColumns(extra).withColumn("target", F.col(target)), _thresholds(spark, family), family)
    return issues.performance_groups(timed).withColumn("threshold_us", F.col("threshold_us").cast("long"))


def _over_sql(family):
    kind, target = _FAMILIES[family]
    name, own, general = _LIMITS[family]
    src = S(kind)
    has = lambda c: f" as {c}" in src
    group = "group_hash" if has("group_hash") else "null"
    user = _USER if has("user_id") else "cast(null as varchar)"
    ts = "ts_us" if has("ts_us") else "cast(null as bigint)"
    us = f"case when {target} = '{name}' then {own * 1000} else {general * 1000} end"
    return f"select case when coalesce({group}, '') = '' then md5({target}) else {group} end as group_hash, coalesce(environment, '') as environment, count(*) as occurrences, max(duration) as triggered_us, cast(max({us}) as bigint) as threshold_us, count(distinct {user}) as users_count, min({ts}) as first_seen, max({ts}) as last_seen from {src} r where duration >= {us} group by 1, 2"


for _family in _FAMILIES:
    QUERIES[f"i_thr_{_family}"] = (partial(over_threshold, family=_family), _over_sql(_family))


@query("f_thr", f"select id, cast(case when connection = 'O' then 40000 else 45000 end as double) as threshold_us from {S('queries')} r where duration >= case when connection = 'O' then 40000 else 45000 end")
def beyond_threshold(spark, d):
    """Records at or above their own threshold: the exact target's or the kind's."""
    rows = records(spark, d, "queries").withColumn("target", F.col("connection"))
    return issues.threshold_of(rows, _thresholds(spark, "query"), "query").where("duration >= threshold_us").select("id", "threshold_us")


@query("a_perf", f"select route_path as name, max(duration) as max_us, cast(round(max(duration) / 1000.0) as bigint) as triggered_ms, count(*) as over from {S('requests')} r where duration >= case when route_path = '/error' then 300 else 200 end group by 1")
def over_by_name(spark, d):
    timed = issues.threshold_of(records(spark, d, "requests").withColumn("target", F.col("route_path")), _thresholds(spark, "route"), "route")
    over = timed.where("duration >= threshold_us").groupBy(F.col("target").alias("name"))
    return over.agg(F.max("duration").alias("max_us"), scalars.millis(F.max("duration")).alias("triggered_ms"), F.count("*").alias("over"))


_PERF = f"(select * from ({_over_sql('mail')}) x)"


@query("i_perf", f"""with g as (select * from {_PERF} g), k as (select group_hash, environment, case occurrences % 3 when 0 then 'open' when 1 then 'resolved' else 'ignored' end as status, occurrences % 50 as occurrences, users_count + 3 as users_count, cast(100 as bigint) as first_seen, cast(200 as bigint) as last_seen,
 cast(7 as bigint) as threshold_ms, cast(triggered_us // 1000 + (occurrences % 2) * 2 - 1 as bigint) as triggered_ms from g where md5(group_hash || environment) < '9')
select group_hash, 'performance' as type, environment, case when k.status is null or k.status = 'resolved' then 'open' else k.status end as status, coalesce(k.occurrences, 0) + g.occurrences as occurrences, greatest(k.users_count, g.users_count) as users_count, coalesce(k.first_seen, g.first_seen) as first_seen, greatest(k.last_seen, g.last_seen) as last_seen,
 case when group_hash < '8' then coalesce(k.threshold_ms, null) else cast(round(g.threshold_us / 1000.0) as bigint) end as threshold_ms, greatest(coalesce(k.triggered_ms, 0), cast(round(g.triggered_us / 1000.0) as bigint)) as triggered_ms
from g left join k using (group_hash, environment)""")
def performance_issues(spark, d):
    """Performance issues after a batch; some groups bring no threshold and keep the stored one."""
    groups = over_threshold(spark, d, "mail").withColumn("type", F.lit("performance")).withColumn("triggered_ms", scalars.millis(F.col("triggered_us")))
    groups = groups.withColumn("threshold_ms", F.when(F.col("group_hash") >= "8", scalars.millis(F.col("threshold_us"))))
    known = groups.where(F.md5(F.concat("group_hash", "environment").cast("binary")) < "9").select(
        _issue_id("group_hash", "environment"), "group_hash", "type", "environment", F.expr("case occurrences % 3 when 0 then 'open' when 1 then 'resolved' else 'ignored' end as status"), (F.col("occurrences") % 50).alias("occurrences"), (F.col("users_count") + 3).alias("users_count"),
        F.lit(100).cast("long").alias("first_seen"), F.lit(200).cast("long").alias("last_seen"), F.lit(7).cast("long").alias("threshold_ms"), F.expr("triggered_us div 1000 + (occurrences % 2) * 2 - 1").alias("triggered_ms"),
    )
    none = activity(known).where("false")
    return issues.upsert_performance(known, issues.classify(groups, known, none, NOW // 1_000_000, _COOL))

# --- joins, sets and storage ---------------------------------------------------


@query("j_trace", f"select r.id as request_id, r.status_code, e.class, l.level from {S('requests')} r join {S('exceptions')} e on r.trace_id = e.trace_id join {S('logs')} l on l.trace_id = r.trace_id")
def traces(spark, d):
    r, e, x = (records(spark, d, k) for k in ("requests", "exceptions", "logs"))
    return r.join(e.select("trace_id", "class"), "trace_id").join(x.select("trace_id", "level"), "trace_id").select(F.col("id").alias("request_id"), "status_code", "class", "level")


_PARTS = "(select p_partkey, p_brand, p_type from part)"


@query("j_dict", "select l_orderkey, l_linenumber, p_brand as brand, p_type as type from lineitem left join part on p_partkey = l_partkey")
def dictionary_join(spark, d):
    """Facts that hold dictionary ids, decoded by one join for each kind."""
    part, lines = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    values = part.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("value")).unionByName(part.select(F.lit("type").alias("kind"), F.col("p_type").alias("value")))
    entries = storage.dictionary(values)
    coded = storage.encode(part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type")), entries, {"brand": "brand", "type": "type"})
    facts = lines.join(coded, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "brand", "type")
    return storage.decode(facts, entries, {"brand": "brand", "type": "type"}).select("l_orderkey", "l_linenumber", "brand", "type")


@query("e_collect", "select distinct 'brand' as kind, p_brand as value from part union all select distinct 'type', p_type from part")
def collected(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(F.explode(F.array(F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("value")), F.struct(F.lit("type").alias("kind"), F.col("p_type").alias("value")))).alias("x")).select("x.*").distinct()


@query("e_warm", "select md5('brand' || chr(0) || value) as id, 'brand' as kind, value from (select distinct p_brand as value from part)")
def warmed(spark, d):
    values = spark.read.parquet(f"{d}/part.parquet").select(F.lit("brand").alias("kind"), F.col("p_brand").alias("value"))
    known = storage.dictionary(values.where("value < 'Brand#3'"))
    return storage.dictionary(values, known)


@query("e_resolve", "select p_partkey, case when p_size < 25 then md5('brand' || chr(0) || p_brand) end as brand from part")
def resolved_ids(spark, d):
    """Values that the dictionary lacks resolve to null."""
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_size") < 25, F.col("p_brand")).otherwise(F.lit("unknown")).alias("brand"))
    entries = storage.dictionary(part.where("brand <> 'unknown'").select(F.lit("brand").alias("kind"), F.col("brand").alias("value")))
    return storage.encode(part, entries, {"brand": "brand"})


@query("src_v1v2", f"select id, status_code, user_id from {S('requests')} r where created_at >= timestamp '2024-01-10 00:00:00'")
def two_families(spark, d):
    rows = records(spark, d, "requests")
    return storage.both_families(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).where("created_at >= timestamp_ntz'2024-01-10 00:00:00'").select("id", "status_code", "user_id")


@query("src_db", f"select min(created_at) as low, max(created_at) as high from {S('requests')} r")
def raw_bounds(spark, d):
    return storage.bounds(records(spark, d, "requests"))


@query("p_compat", f"select id, lower(hex(unhex(group_hash))) as group_hash, coalesce(trace_id, cast(id as string)) as trace_id from {S('requests')} r")
def compat(spark, d):
    rows = records(spark, d, "requests").withColumn("execution_id", F.col("id").cast("string"))
    stored = storage.dedupe_trace(rows).withColumn("hash", F.unhex("group_hash"))
    return storage.restore_trace(stored).select("id", F.lower(F.hex("hash")).alias("group_hash"), "trace_id")


@query("j_map", f"select p.pattern as key, count(*) as n from {S('cache_events')} r join (values ('user:1:view', 'user:a:view'), ('user:2:click', 'user:b:click')) p(raw, pattern) on p.raw = r.key group by 1")
def mapped(spark, d):
    m = spark.createDataFrame([("user:1:view", "user:a:view"), ("user:2:click", "user:b:click")], "key string, pattern string")
    return records(spark, d, "cache_events").join(m, "key").groupBy(F.col("pattern").alias("key")).agg(F.count("*").alias("n"))


@query("j_mapl", f"select coalesce(p.pattern, r.key) as key, count(*) as n from {S('cache_events')} r left join (values ('user:1:view', 'user:a:view')) p(raw, pattern) on p.raw = r.key group by 1")
def mapped_left(spark, d):
    m = spark.createDataFrame([("user:1:view", "user:a:view")], "key string, pattern string")
    return records(spark, d, "cache_events").join(m, "key", "left").groupBy(F.coalesce("pattern", "key").alias("key")).agg(F.count("*").alias("n"))


_CK = r"regexp_replace(key, '(^|:)[0-9]+(:|$)', '\1{int}\2', 'g')"
_CKQ = f"(select {_CK} as key, coalesce(store, '') as store, date_trunc('hour', created_at) as bucket_start, coalesce(environment, '') as environment, count(*) as call_count, count(*) filter (where event_type = 'hit') as hits, cast(coalesce(sum(duration), 0) as bigint) as total_duration from {S('cache_events')} r group by all)"


_KEYS = (
    ("'user:' || user_id || ':x'", "'user:{int}:x'"), ("'mail:a' || user_id || '@h.example.com'", "'mail:{email}'"), ("'day:2024-01-' || lpad(cast(user_id % 28 + 1 as string), 2, '0')", "'day:{date}'"), ("'at:2024-01-02T03:04:' || lpad(cast(user_id % 60 as string), 2, '0') || 'Z'", "'at:{datetime}'"),
    ("'u:' || substr(md5(event_type), 1, 8) || '-' || substr(md5(event_type), 9, 4) || '-4000-8000-' || substr(md5(event_type), 13, 12)", "'u:{uuid}'"), ("'id:01HV9AJ0T4Q2S8B3ZDGKM5NPX' || substr('ABCDEFGH', cast(user_id % 8 + 1 as int), 1)", "'id:{ulid}'"), ("'h:' || md5(event_type)", "'h:{hex}'"),
    ("'s:KywllO9sT7khredx3bfte0iFL35hakXGTcnK4Oi' || substr('ABCDEFGH', cast(user_id % 8 + 1 as int), 1)", "'s:{session}'"), ("'plain:' || event_type", "'plain:' || event_type"),
)


@query("s_ck", "select event_id, case event_id % 9 " + " ".join(f"when {k} then {t}" for k, (_, t) in enumerate(_KEYS)) + " end as key from events")
def templates(spark, d):
    """Cache keys of every sort of volatile part, templated."""
    made = "case event_id % 9 " + " ".join(f"when {k} then {x}" for k, (x, _) in enumerate(_KEYS)) + " end"
    keys = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", made.replace("md5(event_type)", "md5(cast(event_type as binary))") + " as raw")
    return keys.select("event_id", cachekey.template(F.col("raw")).alias("key"))


@query("m_ckr", f"select * from {_CKQ} q")
def rekeyed(spark, d):
    """An existing cache rollup, its keys templated and its rows merged."""
    spec = rollups.SPECS["cache"]
    hourly = rollups.aggregate(records(spark, d, "cache_events"), spec, "hour")
    return rollups.merge(hourly.withColumn("key", cachekey.template(F.col("key"))), spec).select("key", "store", "bucket_start", "environment", "call_count", "hits", "total_duration")


@query("m_ckp", f"select (select count(*) from (select distinct key, store, date_trunc('hour', created_at), environment from {S('cache_events')} r)) as row_count, (select count(*) from {_CKQ} q) as groups")
def rekey_projection(spark, d):
    spec = rollups.SPECS["cache"]
    hourly = rollups.aggregate(records(spark, d, "cache_events"), spec, "hour")
    return hourly.agg(F.count("*").alias("row_count"), F.countDistinct(F.struct(cachekey.template(F.col("key")), *spec.key_columns()[1:])).alias("groups"))


_HITS = f"(select key, coalesce(store, '') as store, count(*) as n from {S('cache_events')} r group by all)"


@query("m_cks", f"select key, store, cast(n - case when key like '%view' then n else 1 end as bigint) as n from {_HITS} h where n - case when key like '%view' then n else 1 end > 0")
def swapped(spark, d):
    """A snapshot plus signed deltas; groups that fall to nothing are gone."""
    base = records(spark, d, "cache_events").groupBy("key", F.coalesce("store", F.lit("")).alias("store")).agg(F.count("*").alias("n"))
    delta = base.withColumn("n", -F.when(F.col("key").endswith("view"), F.col("n")).otherwise(1))
    return storage.merge_signed(base, delta, ["key", "store"], ["n"])


@query("j_anti", "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_shipdate < timestamp '1994-01-01')")
def unreferenced(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where("l_shipdate < timestamp_ntz'1994-01-01 00:00:00'").select(F.col("l_partkey").alias("p_partkey"))
    return spark.read.parquet(f"{d}/part.parquet").join(lines, "p_partkey", "left_anti").select("p_partkey")


@query("j_anti2", f"select distinct l.user_id from {S('requests')} l left join {S('exceptions')} r on l.user_id = r.user_id where r.user_id is null and l.user_id is not null")
def missing_keys(spark, d):
    return records(spark, d, "requests").select("user_id").where("user_id is not null").join(records(spark, d, "exceptions").select("user_id"), "user_id", "left_anti").distinct()


@query("j_semi", f"select distinct fingerprint from {S('exceptions')} e where exists (select 1 from {S('jobs')} j where j.user_id = e.user_id and j.status = 'failed')")
def semi(spark, d):
    failed = records(spark, d, "jobs").where("status = 'failed'").select("user_id")
    return records(spark, d, "exceptions").join(failed, "user_id", "left_semi").select("fingerprint").distinct()


@query("j_updf", f"select g.group_hash, g.n as call_count, coalesce(s.n, 0) as errors from (select group_hash, count(*) as n from {S('requests')} r group by 1) g left join (select group_hash, count(*) as n from {S('requests')} r where status_code >= 400 group by 1) s using (group_hash)")
def update_from(spark, d):
    rows = records(spark, d, "requests")
    s = rows.where("status_code >= 400").groupBy("group_hash").agg(F.count("*").alias("errors"))
    return rows.groupBy("group_hash").agg(F.count("*").alias("call_count")).join(s, "group_hash", "left").select("group_hash", "call_count", F.coalesce("errors", F.lit(0)).alias("errors"))


@query("j_delu", f"select id from {S('cache_events')} r where key not in ('user:1:view', 'user:2:click')")
def delete_using(spark, d):
    gone = spark.createDataFrame([("user:1:view",), ("user:2:click",)], "key string")
    return records(spark, d, "cache_events").join(gone, "key", "left_anti").select("id")


@query("j_scald", f"select j.id, u.n from {S('jobs')} j left join (select user_id, count(distinct fingerprint) as n from {S('exceptions')} e group by 1) u using (user_id) where j.status = 'failed'")
def scalar_distinct(spark, d):
    u = records(spark, d, "exceptions").groupBy("user_id").agg(F.countDistinct("fingerprint").alias("n"))
    return records(spark, d, "jobs").where("status = 'failed'").join(u, "user_id", "left").select("id", "n")


@query("u_all", f"select id, created_at from {S('mail')} m union all select id, created_at from {S('logs')} l")
def union_all(spark, d):
    return records(spark, d, "mail").select("id", "created_at").unionByName(records(spark, d, "logs").select("id", "created_at"))


@query("u_diff", f"with a as (select environment, list(distinct event_type) as x from {S('cache_events')} r where environment is null or environment <> 'staging' group by 1), b as (select environment, list(distinct event_type) as y from {S('cache_events')} r where store is not null and event_type <> 'hit' group by 1) select environment, array_to_string(list_sort(list_filter(x, lambda v: not list_contains(y, v))), ',') as only_a, array_to_string(list_sort(list_intersect(x, y)), ',') as both from a join b on a.environment is not distinct from b.environment".replace("select environment, array_to_string", "select a.environment, array_to_string"))
def set_difference(spark, d):
    rows = records(spark, d, "cache_events")
    a = rows.where("environment is null or environment <> 'staging'").groupBy("environment").agg(F.collect_set("event_type").alias("x"))
    b = rows.where("store is not null and event_type <> 'hit'").groupBy(F.col("environment").alias("e")).agg(F.collect_set("event_type").alias("y"))
    return a.join(b, F.col("environment").eqNullSafe(F.col("e"))).select("environment", F.array_join(F.array_sort(F.array_except("x", "y")), ",").alias("only_a"), F.array_join(F.array_sort(F.array_intersect("x", "y")), ",").alias("both"))


@query("f_nseq", f"select a.environment, a.n, b.m from (select environment, count(*) as n from {S('requests')} r group by 1) a join (select environment, count(*) as m from {S('jobs')} r group by 1) b on a.environment is not distinct from b.environment")
def null_safe(spark, d):
    a = records(spark, d, "requests").groupBy("environment").agg(F.count("*").alias("n"))
    b = records(spark, d, "jobs").groupBy(F.col("environment").alias("e")).agg(F.count("*").alias("m"))
    return a.join(b, F.col("environment").eqNullSafe(F.col("e"))).select("environment", "n", "m")


@query("f_range", f"select id from {S('requests')} r where created_at >= timestamp '2024-01-05 00:00:00' and created_at < timestamp '2024-01-06 00:00:00'")
def time_range(spark, d):
    return records(spark, d, "requests").where("created_at >= timestamp_ntz'2024-01-05 00:00:00' and created_at < timestamp_ntz'2024-01-06 00:00:00'").select("id")


@query("f_in", f"select id from {S('cache_events')} r where (key, event_type) in (('user:1:view', 'hit'), ('user:2:click', 'miss'))")
def tuple_in(spark, d):
    wanted = spark.createDataFrame([("user:1:view", "hit"), ("user:2:click", "miss")], "key string, event_type string")
    return records(spark, d, "cache_events").join(wanted, ["key", "event_type"], "left_semi").select("id")


@query("f_like", f"select regexp_replace(name, '_(hourly|daily)_rollups$', '_rollups') as family, count(*) as n from {_TABLES} t where name like '%rollups' group by 1")
def like_fold(spark, d):
    t = spark.sql("select * from " + _TABLES.replace("from nation", "from {nation}"), nation=spark.read.parquet(f"{d}/nation.parquet"))
    return t.where(F.col("name").like("%rollups")).groupBy(F.regexp_replace("name", "_(hourly|daily)_rollups$", "_rollups").alias("family")).agg(F.count("*").alias("n"))


@query("f_re", "select event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) as double) as k from events where regexp_matches(regexp_extract(props, '([0-9]+)', 1), '^[0-9]+([.][0-9]+)?$')")
def numeric_guard(spark, d):
    text = F.regexp_extract("props", "([0-9]+)", 1)
    return spark.read.parquet(f"{d}/events.parquet").where(text.rlike(r"^[0-9]+(\.[0-9]+)?$")).select("event_id", text.try_cast("double").alias("k"))


@query("o_fifo", f"select id, created_at from {S('requests')} r order by id limit 100")
def fifo(spark, d):
    return records(spark, d, "requests").select("id", "created_at").orderBy("id").limit(100)


@query("o_keyset", f"select distinct key from {S('cache_events')} r where key > 'user:3' order by key limit 50")
def keyset(spark, d):
    return records(spark, d, "cache_events").where("key > 'user:3'").select("key").distinct().orderBy("key").limit(50)


@query("o_top1", f"select id, message from {S('exceptions')} r order by created_at desc, id desc limit 1")
def newest(spark, d):
    return records(spark, d, "exceptions").orderBy(F.desc("created_at"), F.desc("id")).select("id", "message").limit(1)


@query("d_retain", f"select id from {S('requests')} r where created_at >= timestamp '2024-01-18 00:00:00'")
def retained(spark, d):
    return storage.retained(records(spark, d, "requests"), "2024-02-01 00:00:00", 14).select("id")


@query("d_drop", "select distinct cast(ts as date) as day from events where cast(ts as date) + 1 <= date '2024-01-18'")
def expired(spark, d):
    days = spark.read.parquet(f"{d}/events.parquet").select(F.to_date("ts").alias("day")).distinct()
    return storage.expired_days(days, "2024-02-01", 14)


@query("d_gc", "select p_partkey from part where p_size >= 25 and not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def collected_garbage(spark, d):
    entries = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_size") >= 25, F.lit("2024-01-01 00:00:00")).otherwise("2024-02-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    facts = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return storage.orphaned(entries, facts, "p_partkey", "2024-01-25 00:00:00").select("p_partkey")


@query("snk_usr", f"select user_id, arg_max(name, seq) as name, arg_max(email, seq) as email, min(seq) as first_seq from {S('users')} u group by user_id")
def users(spark, d):
    rows = records(spark, d, "users")
    return storage.latest_users(rows)


@query("m_complete", "select case when min(h) is null then 'empty' when max(h) < max(t) - interval 2 hours then 'tail' end as reason from (select ts as t, case when ts < timestamp '2024-01-20' then date_trunc('minute', ts) end as h from events)")
def completeness(spark, d):
    rows = records(spark, d, "requests")
    return storage.completeness(rows, rollups.aggregate(rows.where("created_at < timestamp_ntz'2024-01-20 00:00:00'"), rollups.SPECS["req"]))


@query("m_debt", f"select group_hash as \"table\", min(date_trunc('minute', created_at)) as floor from {S('requests')} r where status_code >= 500 group by 1 union all select 'none', null where false")
def debt(spark, d):
    skipped = records(spark, d, "requests").where("status_code >= 500").select(F.col("group_hash").alias("table"), F.date_trunc("minute", "created_at").cast("timestamp_ntz").alias("bucket_start"))
    return storage.repair_floor(skipped)


# --- scalars and health ----------------------------------------------------------


@query("s_host", f"select id, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) as host from {S('outgoing')} r")
def hosts(spark, d):
    return records(spark, d, "outgoing").select("id", scalars.host(F.col("url")).alias("host"))


@query("s_fp", f"select id, md5(class || '|' || coalesce(message, '') || '|' || coalesce(server, '') || '|' || cast(id as string)) as fp from {S('exceptions')} r")
def fingerprints(spark, d):
    return records(spark, d, "exceptions").select("id", issues.fingerprint(F.col("class"), F.col("message"), F.col("server"), F.col("id")).alias("fp"))


@query("s_uuid", "select event_id, case when event_id % 2 = 0 then lower(substr(md5(event_type), 1, 8) || '-' || substr(md5(event_type), 9, 4) || '-' || substr(md5(event_type), 13, 4) || '-' || substr(md5(event_type), 17, 4) || '-' || substr(md5(event_type), 21, 12)) end as uuid from events")
def uuids(spark, d):
    h = F.upper(F.md5(F.col("event_type").cast("binary")))
    whole = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.uuid(F.when(F.col("event_id") % 2 == 0, whole).otherwise(F.concat(whole, F.lit("x")))).alias("uuid"))


@query("p_tsok", f"select event_id, case when event_id % 3 = 0 then {NOW // 1_000_000} else epoch_us(ts) // 1000000 end as seconds from events")
def plausible(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("17040672000000")).otherwise(F.concat(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), F.lit(".25")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.event_seconds(text, F.lit(NOW // 1_000_000)).alias("seconds"))


@query("p_trunc", "select doc_id, substr(text, 1, 255) as text from documents")
def clamped(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.clamped(F.col("text")).alias("text"))


@query("s_nullph", "select event_id, case when event_id % 4 = 0 then null else props end as context from events")
def placeholders(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.null_placeholder(F.when(F.col("event_id") % 4 == 0, F.lit("{}")).otherwise(F.col("props"))).alias("context"))


@query("s_zip", "select event_id, props from events")
def deflated(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.inflate(scalars.deflate("props")).alias("props"))


@query("s_json", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("s_rtc", f"select id, 'GET ' || route_path as route from {S('requests')} r")
def routes(spark, d):
    return records(spark, d, "requests").select("id", scalars.route_name(F.col("route_methods"), F.col("route_path")).alias("route"))


@query("s_backoff", "select n_nationkey, least(0.1::double * pow(2.0::double, least(n_nationkey - 1, 20)), 10.0::double) as wait from nation where n_nationkey > 0")
def backoff(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey > 0").select("n_nationkey", health.backoff(F.lit(0.1), F.col("n_nationkey")).alias("wait"))


@query("s_pace", "select s_suppkey, greatest(least(900.0::double * greatest(least(1.0::double / (s_suppkey % 9 + 0.5), 2.0), 0.25), 1500.0), 60.0) as next from supplier")
def pacing(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", health.next_window(F.lit(900.0), F.col("s_suppkey") % 9 + F.lit(0.5), 60.0, 1500.0).alias("next"))


_METRICS = """(select c_custkey as subject, 1000 as now, case c_custkey % 7 when 0 then 990 else 0 end as conn_fail_at, 980 as ok_at, case c_custkey % 11 when 0 then 995 else 0 end as error_at, case when c_custkey % 2 = 0 then 'x' end as last_error,
 c_custkey % 300 as worker_stale_s, c_custkey % 5 * 100 as drain_rate, c_custkey % 9 * 100 as ingest_rate, c_custkey * 70 % 100000 as pending, 100000 as max_pending, c_custkey % 50 as quarantined_total, c_custkey % 13 as repair_debt, c_custkey % 17 as stale_rollups,
 case when c_custkey % 3 = 0 then c_custkey * 50 end as backfill_age_s, c_custkey % 19 = 0 as back_pressure, c_custkey * 3 % 3000 as pg_latency_ms, c_custkey % 4 as failed_batches, c_custkey % 30000 as drained_rows, c_custkey % 250 as loop_lag_ms, c_custkey % 150 as wal_mb,
 c_custkey % 20 as metrics_age_s, (c_custkey % 100) / 100.0 as rss_share, (c_custkey % 15) / 100.0 as reject_rate, c_custkey % 100 as cpu, c_custkey % 97 as memory from customer)"""


def _metrics(spark, d):
    return spark.sql("select * from " + _METRICS.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{d}/customer.parquet"))


@query("h_diagnose", health.diagnose_sql(_METRICS, "subject"))
def diagnoses(spark, d):
    return health.diagnose(_metrics(spark, d), ["subject"])


_SCORES = f"(select m.subject, cast(greatest(100 - coalesce(sum(case level when 'critical' then 25 when 'warning' then 10 when 'info' then 2 end), 0), 0) as bigint) as score from {_METRICS} m left join ({health.diagnose_sql(_METRICS, 'subject')}) x using (subject) group by 1)"


@query("s_score", f"select subject, score, case when score >= 80 then 'healthy' when score >= 40 then 'degraded' else 'critical' end as band from {_SCORES} s")
def scores(spark, d):
    m = _metrics(spark, d)
    return health.score(health.diagnose(m, ["subject"]), m, ["subject"])


@query("f_alertable", f"select subject, code from ({health.diagnose_sql(_METRICS, 'subject')}) x where level <> 'info'")
def alertable(spark, d):
    return health.alertable(diagnoses(spark, d)).select("subject", "code")


@query("a_red", "select sum(drained_rows)::bigint as drained, max(wal_mb) as open_issues, arg_max(last_error, (error_at, subject)) as last_error, min(ok_at) as floor, max(worker_stale_s) as staleness, round(avg(pg_latency_ms) filter (where pg_latency_ms > 0), 6) as latency, min(now) as updated_at from " + _METRICS + " m where last_error is not null")
def reduced(spark, d):
    m = _metrics(spark, d).where("last_error is not null").withColumnsRenamed({"drained_rows": "drained", "wal_mb": "open_issues", "subject": "worker", "ok_at": "floor", "worker_stale_s": "staleness", "pg_latency_ms": "latency", "now": "updated_at"})
    return health.reduce_workers(m)


@query("a_fold", f"select regexp_replace(name, '_(hourly|daily)_rollups$', '_rollups') as parent, count(*) as parts, min(max_bucket) as low from {_TABLES} t group by 1")
def folded(spark, d):
    t = spark.sql("select * from " + _TABLES.replace("from nation", "from {nation}"), nation=spark.read.parquet(f"{d}/nation.parquet"))
    return t.groupBy(F.regexp_replace("name", "_(hourly|daily)_rollups$", "_rollups").alias("parent")).agg(F.count("*").alias("parts"), F.min("max_bucket").alias("low"))


# --- read side -------------------------------------------------------------------


@query("q_slow", f"select group_hash, connection, max(duration) as worst, count(*) as calls from {S('queries')} r group by all order by worst desc, group_hash, connection limit 5")
def slow_queries(spark, d):
    return records(spark, d, "queries").groupBy("group_hash", "connection").agg(F.max("duration").alias("worst"), F.count("*").alias("calls")).orderBy(F.desc("worst"), "group_hash", "connection").limit(5)


@query("q_n1", f"select execution_id, group_hash, count(*) as repeats from {S('queries')} r group by all having count(*) > 3")
def repeated_queries(spark, d):
    return records(spark, d, "queries").groupBy("execution_id", "group_hash").agg(F.count("*").alias("repeats")).where("repeats > 3")


@query("q_time", f"select 'request' as kind, id, ts_us from {S('requests')} r where trace_id in ('7', '70', '77') union all select 'exception', id, ts_us from {S('exceptions')} e where trace_id in ('7', '70', '77')")
def timeline(spark, d):
    parts = [records(spark, d, k).where("trace_id in ('7', '70', '77')").select(F.lit(n).alias("kind"), "id", "ts_us") for n, k in (("request", "requests"), ("exception", "exceptions"))]
    return parts[0].unionByName(parts[1]).orderBy("ts_us", "kind", "id")


@query("q_detail", f"select id, created_at from {S('requests')} r where created_at < timestamp '2024-01-15 00:00:00' order by created_at desc, id desc limit 50")
def detail_page(spark, d):
    rows = records(spark, d, "requests").select("id", "created_at")
    return storage.page_after(rows, ["created_at", "id"], (dt.datetime(2024, 1, 15), 0), 50)


@query("q_facet", f"select distinct user_id from {S('jobs')} r where created_at >= timestamp '1995-01-01 00:00:00' and user_id is not null")
def facet(spark, d):
    return records(spark, d, "jobs").where("created_at >= timestamp_ntz'1995-01-01 00:00:00' and user_id is not null").select("user_id").distinct()


_PER = lambda kind, cols: f"(select coalesce(user_id, '') as user_id, {cols} from {S(kind)} r group by 1)"


@query("q_users", f"select coalesce(a.user_id, b.user_id, c.user_id) as user_id, coalesce(requests, 0) as requests, coalesce(errors, 0) as errors, coalesce(attempts, 0) as attempts, coalesce(exceptions, 0) as exceptions from {_PER('requests', 'count(*) as requests, count(*) filter (where status_code >= 500) as errors')} a full join {_PER('jobs', 'count(attempt_id) as attempts')} b using (user_id) full join {_PER('exceptions', 'count(*) as exceptions')} c using (user_id)".replace("coalesce(a.user_id, b.user_id, c.user_id) as user_id", "user_id"))
def user_list(spark, d):
    per = {}
    for name, cols in (("usr_req", {"call_count": "requests", "server_error_count": "errors"}), ("usr_job", {"attempts_count": "attempts"}), ("usr_exc", {"call_count": "exceptions"})):
        spec = rollups.SPECS[name]
        per[name] = rollups.aggregate(records(spark, d, spec.source), spec, "day").groupBy("user_id").agg(*[F.sum(c).alias(n) for c, n in cols.items()])
    out = per["usr_req"].join(per["usr_job"], "user_id", "full_outer").join(per["usr_exc"], "user_id", "full_outer")
    return out.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "errors", "attempts", "exceptions")])


@query("q_srv", f"select fingerprint, count(distinct server) as servers from {S('exceptions')} r group by 1")
def servers(spark, d):
    spec = rollups.SPECS["exc_srv"]
    return rollups.aggregate(records(spark, d, "exceptions"), spec, "day").groupBy("fingerprint").agg(F.countDistinct("server").alias("servers"))


@query("q_guest", f"select fingerprint, count(*) filter (where user_id <> '') as authenticated, count(*) filter (where user_id = '' or user_id is null) as guests from {S('exceptions')} r group by 1")
def guests(spark, d):
    daily = rollups.aggregate(records(spark, d, "exceptions"), rollups.SPECS["exc"], "day")
    return daily.groupBy("fingerprint").agg(F.sum("authenticated_count").alias("authenticated"), F.sum(F.col("call_count") - F.col("authenticated_count")).alias("guests"))


@query("q_chan", f"select group_hash, array_to_string(list_sort(list(distinct channel)), ',') as channels from {S('notifications')} r group by 1")
def channels(spark, d):
    daily = rollups.aggregate(records(spark, d, "notifications"), rollups.SPECS["notif"], "day")
    return daily.groupBy("group_hash").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


@query("q_wide", f"select group_hash, count(*) as call_count from {S('requests')} r where created_at >= timestamp '2024-01-03 00:00:00' and created_at < timestamp '2024-01-10 00:00:00' group by 1")
def tier_routed(spark, d):
    """A window of whole days is read from the daily tier, as that is stored and spans it."""
    spec = rollups.SPECS["req"]
    minute = rollups.aggregate(records(spark, d, "requests"), spec)
    stored = {"minute": minute, "day": rollups.to_tier(minute, spec, "day")}
    window = rollups.read_window(records(spark, d, "requests"), stored, spec, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 10))
    return window.groupBy("group_hash").agg(F.sum("call_count").alias("call_count"))


@query("q_cover", "select min(date_trunc('minute', ts)) <= timestamp '2024-01-05 00:00:00' and max(date_trunc('minute', ts)) >= timestamp '2024-01-20 00:00:00' as covered from events")
def coverage(spark, d):
    low, high = F.min("bucket_start"), F.max("bucket_start")
    rolled = rollups.aggregate(records(spark, d, "requests"), rollups.SPECS["req"])
    return rolled.agg(((low <= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")) & (high >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))).alias("covered"))


@query("q_hit", f"select store, round(hits / cast(nullif(hits + misses, 0) as double), 9) as ratio from (select coalesce(store, '') as store, count(*) filter (where event_type = 'hit') as hits, count(*) filter (where event_type = 'miss') as misses from {S('cache_events')} r group by 1)")
def hit_ratio(spark, d):
    daily = rollups.aggregate(records(spark, d, "cache_events"), rollups.SPECS["cache"], "day")
    return daily.groupBy("store").agg(F.round(F.sum("hits") / F.nullif(F.sum(F.col("hits") + F.col("misses")), F.lit(0)), 9).alias("ratio"))


# --- wire frames -----------------------------------------------------------------

#: For each wire type: more JSON fields as an expression of Spark, the stored kind, and the stored fields as an expression of the oracle.
_USER_OR = "case when user_id % 5 = 0 then '~' else cast(user_id as varchar) end"
_DUR = "cast(floor(value * 1000) as bigint)"
_TYPED = {
    "request": ("case when event_type = 'error' then ',\"status_code\":\"503.0\"' else '' end", "requests", f"md5(event_type) || '|' || {_USER_OR} || '|GET|/|' || case when event_type = 'error' then '503' else '200' end || '|' || {_DUR} || '|[]|~'"),
    "query": ("',\"sql\":\"select 1\",\"connection\":\"pg\",\"file\":\"a.php\",\"line\":7'", "queries", f"md5(event_type) || '|' || {_USER_OR} || '|~|select 1|pg|' || {_DUR} || '|a.php|7'"),
    "exception": ("',\"message\":\"boom\",\"code\":42,\"file\":\"f\"' || case when event_id % 2 = 0 then ',\"class\":\"E\",\"handled\":true' else '' end", "exceptions", f"{_USER_OR} || '|~|' || case when event_id % 2 = 0 then 'E' else 'Unknown' end || '|boom|' || case when event_id % 2 = 0 then 'true' else 'false' end || '|42|f|~|' || md5(event_type)"),
    "command": ("',\"name\":\"migrate\",\"exit_code\":' || cast(event_id % 3 as string)", "commands", f"md5(event_type) || '|' || {_USER_OR} || '|migrate|' || (event_id % 3) || '|' || {_DUR}"),
    "queued-job": ("',\"job_class\":\"JobX\",\"queue\":\"q\"'", "jobs", f"md5(event_type) || '|' || {_USER_OR} || '|~|~|JobX|q|1|' || {_DUR}"),
    "job-attempt": ("',\"name\":\"JobY\",\"job_class\":\"x\",\"queue\":\"q\",\"attempt_id\":\"a\",\"attempts\":\"3\",\"status\":\"released\"'", "jobs", f"md5(event_type) || '|' || {_USER_OR} || '|a|released|JobY|q|3|' || {_DUR}"),
    "cache-event": ("',\"type\":\"' || case user_id % 3 when 0 then 'set_fail' when 1 then 'delete_fail' else 'hit' end || '\",\"key\":\"user:' || cast(user_id as string) || ':x\",\"store\":\"redis\",\"ttl\":60'", "cache_events", f"{_USER_OR} || '|' || case user_id % 3 when 0 then 'set_fail' when 1 then 'delete_fail' else 'hit' end || '|user:' || user_id || ':x|user:{{int}}:x|redis|60|' || {_DUR}"),
    "mail": ("',\"mailable\":\"M1\",\"queued\":\"true\",\"failed\":0'", "mail", f"md5(event_type) || '|' || {_USER_OR} || '|M1|true|false|' || {_DUR}"),
    "notification": ("',\"notification\":\"N1\",\"channel\":\"mail\",\"queued\":false'", "notifications", f"md5(event_type) || '|' || {_USER_OR} || '|N1|mail|false|~|' || {_DUR}"),
    "outgoing-request": ("',\"url\":\"https://h/x\",\"method\":\"POST\",\"status_code\":204'", "outgoing", f"md5(event_type) || '|' || {_USER_OR} || '|POST|https://h/x|204|' || {_DUR}"),
    "scheduled-task": ("',\"command\":\"c1\",\"expression\":\"* * * * *\",\"status\":\"failed\",\"exit_code\":1'", "scheduled", f"md5(event_type) || '|c1|* * * * *|0|failed|1|' || {_DUR}"),
    "log": ("',\"message\":\"m\",\"context\":\"{{}}\",\"channel\":\"app\"'".replace("{{}}", "{}"), "logs", f"{_USER_OR} || '|info|m|~|app'"),
    "user": ("',\"id\":\"u' || cast(user_id as string) || '\",\"name\":\"n\",\"username\":\"e@x\"'", "users", "'u' || user_id || '|n|e@x'"),
}
_T_OF = "case event_id % 13 " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(_TYPED)) + " end"
#: What is wrong with a frame, if anything; of each sort some.
_FAULT = "case when event_id % 50 = 0 then 'ping' when event_id % 51 = 0 then 'json' when event_id % 53 = 0 then 'version' when event_id % 59 = 0 then 'utf8' when event_id % 61 = 0 then 'garbage' when event_id % 67 = 0 then 'behind' when event_id % 71 = 0 then 'token' when event_id % 73 = 0 then 'number' when event_id % 79 = 0 then 'header' else '' end"
_KIND = f"case {_FAULT} when 'ping' then 'ping' when 'version' then 'error' when 'json' then null when 'utf8' then null when 'garbage' then null when 'header' then null else 'records' end"


def _wire(spark, d) -> DataFrame:
    """Every event as a frame of one record of the 13 types; some are pings, some broken."""
    extra = "case event_id % 13 " + " ".join(f"when {k} then {x}" for k, (x, _, _) in enumerate(_TYPED.values())) + " end"
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("*", f"{_T_OF} as t", f"{_FAULT} as fault", f"{extra} as extra", "md5(cast(event_type as binary)) as g", "cast(unix_timestamp(cast(ts as timestamp)) as string) as at", "cast(cast(floor(value * 1000) as bigint) as string) as us")
    user = "case when user_id % 5 = 0 then '' else concat(',\"user\":\"', cast(user_id as string), '\"') end"
    duration = "case when fault = 'number' then '\"fast\"' when event_id % 2 = 0 then concat('\"', us, '.5\"') else us end"
    e = e.select("event_id", "t", "at", "g", "us", "user_id", F.explode(F.array("fault")).alias("fault"), "extra")
    body = F.expr(f"""concat('[{{"t":"', t, '","timestamp":"', at, '","_group":"', g, '","trace_id":"', cast(event_id as string), '","duration":', {duration}, {user}, extra, '}}]')""")
    text = F.when(F.col("fault") == "ping", "PING").when(F.col("fault") == "json", "{broken").when(F.col("fault") == "garbage", F.concat(body, F.lit("XX"))).otherwise(body).cast("binary")
    payload = F.when(F.col("fault") == "utf8", F.concat(F.expr("cast(concat('[{\"t\":\"log\",\"message\":\"') as binary)"), F.unhex(F.lit("FF")), F.lit('"}]').cast("binary"))).otherwise(text)
    token = F.when(F.col("fault") == "token", F.repeat(F.lit("long"), 40)).when(F.col("event_id") % 20 == 7, "other").otherwise("abc1234")
    content = F.concat(F.when(F.col("fault") == "version", "v2:").otherwise("v1:").cast("binary"), token.cast("binary"), F.lit(":").cast("binary"), payload)
    frame = F.concat(F.octet_length(content).cast("string").cast("binary"), F.lit(":").cast("binary"), content, F.when(F.col("fault") == "behind", "tail]").otherwise("").cast("binary"))
    raw = F.when(F.col("fault") == "header", F.lit("no frame").cast("binary")).otherwise(frame)
    return e.select(F.explode(F.array(raw)).alias("raw"), "event_id")  # a frame is made once


@query("src_parse", f"select {_KIND} as kind, count(*) as n from events group by 1")
def parsed(spark, d):
    return frames.parse(_wire(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query("src_auth", f"select count(*) as n from events where {_FAULT} = 'ping' or (event_id % 20 <> 7 and {_FAULT} not in ('token', 'header'))")
def authorised(spark, d):
    return frames.authorised(frames.parse(_wire(spark, d)), "abc1234").agg(F.count("*").alias("n"))


@query("src_frame", f"select count(*) filter (where {_FAULT} <> 'header') as complete, count(*) filter (where {_FAULT} <> 'header' and false) as cut from events")
def complete(spark, d):
    """Whole frames are complete, and none of them without its last byte, unless bytes follow the frame."""
    w = _wire(spark, d)
    cut = F.expr("substring(raw, 1, octet_length(raw) - 6)")
    return w.agg(F.count_if(frames.complete(F.col("raw"))).alias("complete"), F.count_if(frames.complete(cut)).alias("cut"))


_SOUND = f"{_FAULT} in ('', 'behind', 'token')"


@query("a_types", f"select {_T_OF} as t, count(*) as n from events where {_SOUND} group by 1")
def types(spark, d):
    return frames.type_counts(frames.parse(_wire(spark, d)))


@query("snk_dlq", f"select count(*) filter (where {_KIND} is null or {_KIND} = 'error') as dead, count(*) filter (where {_FAULT} = 'number') as rejected from events")
def dead(spark, d):
    """Frames without records, whatever their token, and records whose numbers are none."""
    p = frames.parse(_wire(spark, d))
    a, b = frames.dead_letters(p).agg(F.count("*").alias("dead")), frames.rejected(p).agg(F.count("*").alias("rejected"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").select("dead", "rejected")


@query("p_def", f"select md5(event_type) as group_hash, count(*) as call_count, count(*) filter (where event_type <> 'error') as success_count, count(*) filter (where event_type = 'error') as server_error_count from events where {_SOUND} and event_id % 13 = 0 group by 1")
def wire_rollup(spark, d):
    """Frames to records to normalised requests to a rollup: missing fields get defaults, numbers may be text."""
    rows = frames.normalise(frames.records(frames.parse(_wire(spark, d))), "requests", "production", NOW // 1_000_000)
    return rollups.aggregate(rows, rollups.SPECS["req"], "day").groupBy("group_hash").agg(*[F.sum(c).alias(c) for c in ("call_count", "success_count", "server_error_count")])


_COMMON = ("created_at", "ts_us", "environment", "server", "trace_id")


@query("p_route", "select event_id as id, kind, epoch_us(ts) // 1000000 * 1000000 as ts_us, stored from (" + " union all ".join(f"select event_id, ts, '{kind}' as kind, {out} as stored from events where {_SOUND} and event_id % 13 = {k}" for k, (_, kind, out) in enumerate(_TYPED.values())) + ") x")
def routed(spark, d):
    """Every record of the 13 types, as its kind's writer stores it."""
    rows, out = frames.records(frames.parse(_wire(spark, d))), None
    for kind in dict.fromkeys(k for _, k, _ in _TYPED.values()):
        n = frames.normalise(rows, kind, "production", NOW // 1_000_000)
        own = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in n.columns if c not in _COMMON]
        part = n.select(F.col("trace_id").cast("long").alias("id"), F.lit(kind).alias("kind"), "ts_us", F.concat_ws("|", *own).alias("stored"))
        out = part if out is None else out.unionAll(part)
    return out


@query("a_cache_fail", f"select 'user:{{int}}:x' as key, count(*) as call_count, count(*) filter (where user_id % 3 = 2) as hits, count(*) filter (where user_id % 3 = 1) as delete_failures, count(*) filter (where user_id % 3 = 0) as write_failures from events where {_SOUND} and event_id % 13 = 6 group by 1")
def cache_failures(spark, d):
    """Failed writes and deletes of the cache, from the wire to the rollup."""
    rows = frames.normalise(frames.records(frames.parse(_wire(spark, d))), "cache_events", None, NOW // 1_000_000)
    return rollups.aggregate(rows, rollups.SPECS["cache"], "day").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("call_count", "hits", "delete_failures", "write_failures")])


@query("a_vit", f"select day, requests, server_errors, exceptions, cast(sum(requests) over w as bigint) as requests_total, cast(sum(server_errors) over w as bigint) as server_errors_total, cast(sum(exceptions) over w as bigint) as exceptions_total from (select cast(ts as date) as day, count(*) as requests, count(*) filter (where event_type = 'error') as server_errors, count(*) filter (where event_type = 'error') as exceptions from events group by 1) x window w as (order by day)")
def vitals(spark, d):
    """Requests, server errors and exceptions of each day's batch, and their totals so far."""
    r = records(spark, d, "requests").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 500).alias("server_errors"))
    x = records(spark, d, "exceptions").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("exceptions"))
    cols = ("requests", "server_errors", "exceptions")
    day = r.join(x, "day", "full_outer").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
    so_far = Window.orderBy("day")  # one row a batch
    return day.select("*", *[F.sum(c).over(so_far).alias(f"{c}_total") for c in cols])


# --- retention, tiers, host metrics and reports -------------------------------------


@query("d_retain_tiers", " union all ".join(f"select '{k}' as kind, count(*) as kept from {S('jobs')} r where date_trunc('{t}', created_at) >= timestamp '1998-08-01 00:00:00' - interval {n} day" for k, t, n in (("minute", "minute", 90), ("hour", "hour", 366), ("day", "day", 1100))) + f" union all select 'raw', count(*) from {S('jobs')} r where created_at >= timestamp '1998-08-01 00:00:00' - interval 14 day union all select 'raw hours', count(*) from {S('jobs')} r where created_at >= timestamp '1998-08-01 00:00:00' - interval 36 hour")
def retention(spark, d):
    """Raw rows and rollups of each tier that their retention windows keep."""
    rows, now = records(spark, d, "jobs"), "1998-08-01 00:00:00"
    spec = rollups.SPECS["job"]
    parts = [storage.kept(rollups.aggregate(rows, spec, t), now, t).agg(F.coalesce(F.sum("call_count"), F.lit(0)).alias("kept")).select(F.lit(t).alias("kind"), "kept") for t in rollups.TIERS]
    parts += [storage.kept(rows, now, "raw", h).agg(F.count("*").alias("kept")).select(F.lit(k).alias("kind"), "kept") for k, h in (("raw", None), ("raw hours", 36))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


@query("q_cover_raw", f"select group_hash, count(*) as call_count from {S('requests')} r where created_at >= timestamp '2024-01-05 00:00:00' and created_at < timestamp '2024-01-25 00:00:00' group by 1")
def gated(spark, d):
    """A window that the stored rollup does not span is read from raw rows."""
    spec, rows = rollups.SPECS["req"], records(spark, d, "requests")
    stored = rollups.aggregate(rows.where("created_at < timestamp_ntz'2024-01-20 00:00:00'"), spec, "hour")
    window = rollups.read_window(rows, {"hour": stored}, spec, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25))
    return window.groupBy("group_hash").agg(F.sum("call_count").alias("call_count"))


@query("snk_v2", f"select id, created_at, group_hash, route_path, url, status_code, coalesce(trace_id, cast(id as varchar)) as trace_id from {S('requests')} r")
def second_family(spark, d):
    """Requests written in the second family's types and decoded again."""
    rows = records(spark, d, "requests").select("id", "created_at", "group_hash", "route_path", "url", "status_code", "trace_id", F.col("id").cast("string").alias("execution_id"))
    entries = storage.dictionary(storage.collect_values(rows, "requests"))
    return storage.from_v2(storage.to_v2(rows, "requests", entries), "requests", entries).select("id", "created_at", "group_hash", "route_path", "url", "status_code", "trace_id")


@query("m_plan", "select n_name as \"table\", case n_nationkey % 3 when 0 then 'minute' when 1 then 'hour' else 'day' end as tier, case when n_nationkey % 5 = 0 then 'rebuild' when n_nationkey % 4 in (0, 1) then 'backfill' when n_nationkey % 4 = 2 then 'extend' end as action, case when n_nationkey % 5 = 0 then cast(n_nationkey * 60 as bigint) end as since from nation where n_nationkey % 5 = 0 or n_nationkey % 4 <> 3")
def planned(spark, d):
    tables = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_name as table", "case n_nationkey % 3 when 0 then 'minute' when 1 then 'hour' else 'day' end as tier", "case n_nationkey % 4 when 0 then 'empty' when 1 then 'head' when 2 then 'tail' end as reason", "cast(case when n_nationkey % 5 = 0 then n_nationkey * 60 end as bigint) as floor")
    return storage.repair_plan(tables, 10_000)


@query("o_worst", "select s_suppkey as worker, s_suppkey * 37 % 101 as stale_s, 'write' as phase from supplier where s_suppkey * 37 % 101 > 0 order by stale_s desc, worker limit 1")
def worst(spark, d):
    return health.worst_wedge(spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as worker", "s_suppkey * 37 % 101 as stale_s", "'write' as phase"))


@query("src_proc", """with c as (select user_id % 4 as host, event_id as tick, sum(cast(value as bigint) + 1) over w as total, sum(cast(value as bigint) % 7) over w as idle from events window w as (partition by user_id % 4 order by event_id)),
x as (select host, tick, total - lag(total) over w as t, idle - lag(idle) over w as i from c window w as (partition by host order by tick))
select host, tick, case when t > 0 then round((1 - i / cast(t as double)) * 100, 1) when t is not null then 0.0 end as usage_pct from x""".replace("cast(value as bigint)", "cast(floor(value) as bigint)"))
def processor(spark, d):
    w = Window.partitionBy("host").orderBy("tick")
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id % 4 as host", "event_id as tick", "cast(floor(value) as bigint) as v")
    samples = e.select("host", "tick", F.sum(F.col("v") + 1).over(w).alias("total"), F.sum(F.col("v") % 7).over(w).alias("idle"))
    return health.cpu_usage(samples, ["host"], "tick").select("host", "tick", "usage_pct")


@query("s_unit", "select l_orderkey, l_linenumber, cast(round(l_extendedprice / 1000.0) as bigint) as ms, round(l_extendedprice * 100000 / 60000000.0, 9) as busy from lineitem".replace("l_extendedprice", "cast(floor(l_extendedprice) as bigint)"))
def units(spark, d):
    us = F.floor("l_extendedprice").cast("long")
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", scalars.millis(us).alias("ms"), F.round(scalars.busy_workers(us * 100000), 9).alias("busy"))


_BYTES = "(select o_orderkey, cast(floor(o_totalprice) as bigint) * (case o_orderkey % 3 when 0 then 1 when 1 then 100 else 50000 end) as n, cast(floor(o_totalprice) as bigint) as sec from orders)"


@query("s_fmt", f"select o_orderkey, case when n < 1048576 then regexp_replace(cast(round(n / 1024.0::double, 1) as varchar), '[.]0$', '') || ' KB' when n < 1073741824 then regexp_replace(cast(round(n / 1048576.0::double, 1) as varchar), '[.]0$', '') || ' MB' else regexp_replace(cast(round(n / 1073741824.0::double, 1) as varchar), '[.]0$', '') || ' GB' end as size, case when sec >= 172800 then (sec // 86400) || ' days' when sec >= 7200 then (sec // 3600) || ' hours' else greatest(sec // 60, 1) || ' minutes' end as age, printf('Avg concurrency held at ≥90%% of 4 workers for 2 consecutive minutes (worst minute: %.1f busy)', sec * 1000 / 60000000.0::double) as message from {_BYTES} b")
def formatted(spark, d):
    n, sec = F.col("n"), F.col("sec")
    rows = spark.sql("select * from " + _BYTES.replace("from orders", "from {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    return rows.select("o_orderkey", scalars.human_bytes(n).alias("size"), scalars.human_seconds(sec).alias("age"), scalars.saturation_message(90, 4, 2, sec * 1000).alias("message"))


@query("s_retries", "select o_orderkey, o_orderkey > 0 and bit_count(o_orderkey) = 1 as logged from orders")
def logged_retries(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", scalars.is_power_of_two(F.col("o_orderkey")).alias("logged"))


#: The fixed thresholds written out once more, apart from the rules, by boundary values: (metrics row, its codes).
_CALM = {"now": 1000, "conn_fail_at": 0, "ok_at": 990, "error_at": 0, "worker_stale_s": 0, "drain_rate": 100, "ingest_rate": 100, "pending": 0, "max_pending": 100000, "quarantined_total": 0, "repair_debt": 0, "stale_rollups": 0, "pg_latency_ms": 10, "failed_batches": 0, "drained_rows": 9000, "loop_lag_ms": 1, "wal_mb": 1, "metrics_age_s": 1, "rss_share": 0.1, "reject_rate": 0.0, "cpu": 5, "memory": 5}
BOUNDARIES = (
    ({}, ""), ({"conn_fail_at": 995, "last_error": "x"}, "DRAIN_UNREACHABLE"), ({"now": 1039, "conn_fail_at": 995, "last_error": "x"}, "DRAIN_UNREACHABLE"), ({"now": 1040, "conn_fail_at": 995, "last_error": "x"}, ""), ({"worker_stale_s": 180}, ""), ({"worker_stale_s": 181}, "DRAIN_WEDGED"),
    ({"error_at": 991}, "DRAIN_WRITE_FAILING"), ({"error_at": 990}, ""), ({"drain_rate": 0, "ingest_rate": 0, "pending": 101}, "DRAIN_STOPPED"), ({"drain_rate": 0, "ingest_rate": 0, "pending": 100}, ""), ({"quarantined_total": 1}, "DRAIN_QUARANTINE"), ({"repair_debt": 1}, "ROLLUP_REPAIR_PENDING"),
    ({"stale_rollups": 1}, "ROLLUP_STALE"), ({"backfill_age_s": 21600}, "ROLLUP_BACKFILL_PENDING"), ({"backfill_age_s": 21601}, "ROLLUP_BACKFILL_PENDING"), ({"ingest_rate": 151, "pending": 5001}, "DRAIN_FALLING_BEHIND"), ({"ingest_rate": 150, "pending": 5001}, ""), ({"ingest_rate": 151, "pending": 5000}, ""),
    ({"pending": 50000}, ""), ({"pending": 50001}, "BACKLOG_HIGH"), ({"pending": 80000}, "BACKLOG_HIGH"), ({"pending": 80001}, "BACKLOG_CRITICAL"), ({"back_pressure": True}, "BACK_PRESSURE_ACTIVE"), ({"pg_latency_ms": 500}, ""), ({"pg_latency_ms": 501}, "PG_LATENCY_HIGH"), ({"pg_latency_ms": 2000}, "PG_LATENCY_HIGH"),
    ({"pg_latency_ms": 2001}, "PG_LATENCY_CRITICAL"), ({"failed_batches": 1}, ""), ({"failed_batches": 2}, "DRAIN_ERRORS"), ({"loop_lag_ms": 50}, ""), ({"loop_lag_ms": 51}, "LOOP_LAG_HIGH"), ({"loop_lag_ms": 201}, "LOOP_LAG_CRITICAL"), ({"wal_mb": 100}, ""), ({"wal_mb": 101}, "WAL_LARGE"), ({"metrics_age_s": 15}, ""),
    ({"metrics_age_s": 16}, "DRAIN_METRICS_STALE"), ({"rss_share": 0.7}, ""), ({"rss_share": 0.71}, "MEMORY_HIGH"), ({"reject_rate": 0.02}, ""), ({"reject_rate": 0.03}, "REJECT_RATE_HIGH"), ({"reject_rate": 0.11}, "REJECT_RATE_CRITICAL"), ({"cpu": 70}, ""), ({"cpu": 71}, "CPU_HIGH"), ({"cpu": 91}, "CPU_SATURATION"),
    ({"memory": 75}, ""), ({"memory": 76}, "SYSTEM_MEMORY_HIGH"), ({"memory": 91}, "SYSTEM_MEMORY_CRITICAL"),
)


def _boundary_sql():
    rows = ", ".join(f"({k}, '{code}')" for k, (_, code) in enumerate(BOUNDARIES))
    return f"select subject, code from (values {rows}) v(subject, code) where code <> ''"


@query("h_boundaries", _boundary_sql())
def boundaries(spark, d):
    """Each health rule just below and just above its threshold."""
    kinds = {"last_error": "string", "back_pressure": "boolean", "rss_share": "double", "reject_rate": "double"}
    names = [m for m in health.METRICS]
    rows = [(k, *[({**_CALM, **change}).get(m) for m in names]) for k, (change, _) in enumerate(BOUNDARIES)]
    m = spark.createDataFrame(rows, "subject int, " + ", ".join(f"{m} {kinds.get(m, 'bigint')}" for m in names))
    return health.diagnose(m, ["subject"]).select("subject", "code")


@query("snk_health", f"select subject, case when score >= 80 then 'healthy' when score >= 40 then 'degraded' else 'critical' end as status, score as health_score, pending as pending_rows, codes from (select s.subject, s.score, m.pending, coalesce(x.codes, '') as codes from {_SCORES} s join {_METRICS} m using (subject) left join (select subject, array_to_string(list_sort(list(code)), ',') as codes from ({health.diagnose_sql(_METRICS, 'subject')}) y group by 1) x using (subject)) z")
def health_report(spark, d):
    """Fields read back from the JSON health documents."""
    m = _metrics(spark, d)
    found = health.diagnose(m, ["subject"])
    documents = health.report(m, found, health.score(found, m, ["subject"]), ["subject"])
    shape = "struct<status: string, health_score: bigint, buffer: struct<pending_rows: bigint>, diagnoses: array<struct<code: string>>>"
    r = documents.select("subject", F.from_json("report", shape).alias("r"))
    return r.select("subject", "r.status", "r.health_score", F.col("r.buffer.pending_rows").alias("pending_rows"), F.array_join(F.array_sort(F.col("r.diagnoses.code")), ",").alias("codes"))


def build() -> dict:
    return dict(QUERIES)
