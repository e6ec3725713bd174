"""Rollups in every tier, histograms, sketches, merges and percentiles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from quillon.functions import histogram, sketch
from quillon.operators import rollups as R, storage
from quillon.sources.adapters import records, records_sql


def _minute(spark, d, spec):
    return R.aggregate(records(spark, d, spec.source), spec)


def _tier(spark, d, spec, tier):
    hour = R.to_tier(_minute(spark, d, spec), spec, "hour")
    return hour if tier == "hour" else R.to_tier(hour, spec, "day")


def _merged(spark, d, spec):
    """Two batches aggregated apart and merged equal one aggregation of all."""
    rows = records(spark, d, spec.source)
    parts = [R.aggregate(rows.where(F.col("id") % 2 == k), spec) for k in (0, 1)]
    return R.merge(parts[0].unionByName(parts[1]), spec)


def _hist(spark, d, spec):
    return R.histogram_rows(records(spark, d, spec.source), spec, "day")


def _sketch(spark, d, spec):
    minute = R.sketch_rows(records(spark, d, spec.source), spec)
    daily = minute.withColumn("bucket_start", F.date_trunc("day", "bucket_start").cast("timestamp_ntz"))
    return sketch.merge(daily, spec.key_columns())


def p95_by_hour(spark, d):
    """p95 of request durations for each group and hour, from sketches with ranges."""
    keys = ["group_hash", "bucket_start"]
    rows = R.durations(records(spark, d, "requests"), R.SPECS["req"], "hour")
    return sketch.percentile(sketch.add_ranged(rows, keys), keys, 0.95).select(*keys, F.round("estimate", 3).alias("p95_us"))


def _p95_sql():
    rows = f"(select group_hash, date_trunc('hour', created_at) as bucket_start, duration from {records_sql('requests')} r)"
    cells = f"(select group_hash, bucket_start, {sketch.index_sql('duration')} as idx, count(*) as cnt, min(min(duration)) over (partition by group_hash, bucket_start) as min_duration, max(max(duration)) over (partition by group_hash, bucket_start) as max_duration from {rows} x group by group_hash, bucket_start, idx)"
    return f"select group_hash, bucket_start, round(estimate, 3) as p95_us from ({sketch.percentile_sql(cells, 'group_hash, bucket_start', 0.95)})"


def percentiles(spark, d, name, quantiles=(0.5, 0.95, 0.99)):
    """Percentiles of a spec's durations by its first key, over all time."""
    spec = R.SPECS[name]
    key = list(spec.keys)[:1]
    rows = R.durations(records(spark, d, spec.source), spec)
    return sketch.percentiles(sketch.add_ranged(rows, key), key, quantiles).select(*key, "q", F.round("estimate", 3).alias("us"))


def _percentiles_sql(name, quantiles=(0.5, 0.95, 0.99)):
    spec = R.SPECS[name]
    key, expr = list(spec.keys.items())[0]
    cells = f"(select {key}, {sketch.index_sql('duration')} as idx, count(*) as cnt, min(min(duration)) over (partition by {key}) as min_duration, max(max(duration)) over (partition by {key}) as max_duration from (select {expr} as {key}, duration from {records_sql(spec.source)} r0 where {spec.duration_where} and duration is not null) x group by {key}, idx)"
    return " union all ".join(f"select {key}, cast({q} as double) as q, round(estimate, 3) as us from ({sketch.percentile_sql(cells, key, q)})" for q in quantiles)


def hist_percentile(spark, d):
    spec = R.SPECS["req"]
    rows = records(spark, d, "requests")
    bins = rows.groupBy("group_hash", histogram.bin_of(F.col("duration")).alias("bin")).agg(F.count("*").alias("n"))
    rng = rows.groupBy("group_hash").agg(F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"))
    return histogram.percentile(bins.join(rng, "group_hash"), ["group_hash"], 0.95).select("group_hash", F.round("estimate", 3).alias("p95_us"))


def _hist_percentile_sql():
    edges = "[" + ", ".join(map(str, histogram.EDGES)) + "]"
    return f"""
with b as (select group_hash, {histogram.bin_sql('duration')} as bin, count(*) as n from {records_sql('requests')} r group by all),
m as (select group_hash, min(duration) as lo0, max(duration) as hi0 from {records_sql('requests')} r group by 1),
w as (select *, sum(n) over (partition by group_hash) as total, sum(n) over (partition by group_hash order by bin) as upto from b join m using (group_hash)),
c as (select *, greatest(ceil(total * 0.95::double), 1) as rank from w),
e as (select *, cast(greatest(case when bin = 0 then 0 else {edges}[bin] end, lo0) as double) as lo, cast(least({edges}[bin + 1], hi0) as double) as hi, (rank - (upto - n)) / n::double as within from c where upto >= rank and upto - n < rank)
select group_hash, round(case when lo > 0 then lo * pow(greatest(hi, lo) / lo, within) else greatest(hi, lo) * within end, 3) as p95_us from e"""


def upconverted(spark, d):
    """Histogram bins moved into sketch buckets, by group."""
    rows = records(spark, d, "requests")
    bins = rows.groupBy("group_hash", histogram.bin_of(F.col("duration")).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("group_hash", sketch.upconverted().alias("idx")).agg(F.sum("n").alias("cnt"))


def _upconverted_sql():
    e = histogram.EDGES
    mids = [e[0] / 2, *((a * b) ** 0.5 for a, b in zip(e, e[1:])), e[-1]]
    rungs = "[" + ", ".join(str(sketch.index(m)) for m in mids) + "]"
    return f"select group_hash, {rungs}[bin + 1] as idx, cast(sum(n) as bigint) as cnt from (select group_hash, {histogram.bin_sql('duration')} as bin, count(*) as n from {records_sql('requests')} r group by all) group by 1, 2"


def sample_counts(spark, d):
    """Samples in each group's packed sketch, after a round trip through its bytes."""
    cells = sketch.add(records(spark, d, "requests"), ["group_hash"])
    return sketch.packed(cells, ["group_hash"]).select("group_hash", sketch.sample_count(F.col("sketch")).alias("samples"))


def covered(spark, d):
    """Groups by whether their sketch holds at least the histogram's mass; sketches began on a date."""
    rows = R.durations(records(spark, d, "jobs"), R.SPECS["job"])
    began = rows.where(F.col("created_at") >= F.when(F.col("group_hash") == F.md5(F.lit("1-URGENT").cast("binary")), F.lit("1995-01-01")).otherwise("1900-01-01").cast("timestamp_ntz"))
    a = sketch.add(began, ["group_hash"]).groupBy("group_hash").agg(F.sum("cnt").alias("samples"))
    bins = rows.groupBy("group_hash", histogram.bin_of(F.col("duration")).alias("bin")).agg(F.count("*").alias("n"))
    b = bins.groupBy("group_hash").agg(F.sum("n").alias("mass"))
    samples = F.coalesce("samples", F.lit(0))
    return b.join(a, "group_hash", "left").select("group_hash", samples.alias("samples"), "mass", (samples >= F.col("mass")).alias("covered"))


_OLD = "timestamp '2024-01-15 00:00:00'"


def mixed_percentiles(spark, d):
    """p95 by group and day where days before a date hold histogram bins alone and later ones sketches."""
    keys = ["group_hash", "bucket_start"]
    rows = R.durations(records(spark, d, "requests"), R.SPECS["req"], "day")
    late = F.col("bucket_start") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    bins = rows.groupBy(*keys, histogram.bin_of(F.col("duration")).alias("bin")).agg(F.count("*").alias("n"))
    cells = sketch.with_bins(sketch.add(rows.where(late), keys), bins, keys)
    ranges = rows.groupBy(*keys).agg(F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"))
    return sketch.percentile(cells.join(ranges, keys), keys, 0.95).select(*keys, F.round("estimate", 3).alias("p95_us"))


def _mixed_sql():
    rows = f"(select group_hash, date_trunc('day', created_at) as bucket_start, duration from {records_sql('requests')} r)"
    rung = _rungs()
    cells = f"""(select c.*, m.min_duration, m.max_duration from (
      select group_hash, bucket_start, case when bucket_start >= {_OLD} then {sketch.index_sql('duration')} else {rung}[{histogram.bin_sql('duration')} + 1] end as idx, count(*) as cnt from {rows} x group by all) c
      join (select group_hash, bucket_start, min(duration) as min_duration, max(duration) as max_duration from {rows} y group by all) m using (group_hash, bucket_start))"""
    return f"select group_hash, bucket_start, round(estimate, 3) as p95_us from ({sketch.percentile_sql(cells, 'group_hash, bucket_start', 0.95)})"


def _rungs():
    e = histogram.EDGES
    return "[" + ", ".join(str(sketch.index(m)) for m in (e[0] / 2, *((a * b) ** 0.5 for a, b in zip(e, e[1:])), e[-1])) + "]"


def narrow_rollup(spark, d, grouped: bool = True):
    """Percentile read over stored rollup cells: 200 groups of 336 hours each, merged by 50 groups or into one.

    The shape of the published sketch aggregate figures: 67,200 rollup rows.
    """
    rows = records(spark, d, "queries").select((F.col("id") % 200).alias("route"), (F.expr("id div 200") % 336).alias("hour"), "duration")
    stored = sketch.add_ranged(rows, ["route", "hour"])
    key = [F.expr("route % 50").alias("k")] if grouped else [F.lit(0).cast("long").alias("k")]
    cells = stored.groupBy(*key, "idx").agg(F.sum("cnt").alias("cnt"), F.min("min_duration").alias("min_duration"), F.max("max_duration").alias("max_duration"))
    return sketch.percentiles(cells, ["k"], (0.5, 0.95)).select("k", "q", F.round("estimate", 3).alias("us"))


def _narrow_sql(grouped: bool = True):
    key = "id % 200 % 50" if grouped else "cast(0 as bigint)"
    cells = f"(select k, idx, count(*) as cnt, min(min(duration)) over (partition by k) as min_duration, max(max(duration)) over (partition by k) as max_duration from (select {key} as k, {sketch.index_sql('duration')} as idx, duration from {records_sql('queries')} r) x group by k, idx)"
    return " union all ".join(f"select k, cast({q} as double) as q, round(estimate, 3) as us from ({sketch.percentile_sql(cells, 'k', q)})" for q in (0.5, 0.95))


def drifted(spark, d):
    """An hourly rollup with one group's rows missing and another's counts wrong against the raw rows."""
    spec = R.SPECS["req"]
    rows = records(spark, d, "requests")
    fresh = R.aggregate(rows, spec, "hour").groupBy("group_hash").agg(F.sum("call_count").alias("call_count"))
    views, errors = (F.md5(F.lit(x).cast("binary")) for x in ("view", "error"))
    stored = R.to_tier(R.aggregate(rows, spec), spec, "hour").groupBy("group_hash").agg(F.sum("call_count").alias("call_count"))
    stored = stored.where(F.col("group_hash") != views).withColumn("call_count", F.col("call_count") + (F.col("group_hash") == errors).cast("long"))
    return storage.drift(stored, fresh)


_DRIFT_SQL = """with g as (select md5(event_type) as group_hash, event_type, count(*) as n from events group by all)
select group_hash, n as call_count, 'b' as side from g where event_type in ('view', 'error')
union all select group_hash, n + 1, 'a' from g where event_type = 'error'"""


def tier_gaps(spark, d):
    """Daily rows that do not hold their hours' sum, after one hour's rows were lost from the day."""
    spec = R.SPECS["req"]
    hour = R.aggregate(records(spark, d, "requests"), spec, "hour")
    day = R.to_tier(hour.where("hour(bucket_start) <> 7"), spec, "day")
    return storage.tier_gaps(hour, day, "day", ["group_hash", "environment"])


_TIER_GAPS_SQL = f"""with r as (select group_hash, coalesce(environment, '') as environment, date_trunc('day', created_at) as bucket_start, hour(created_at) as h from {records_sql('requests')} x)
select group_hash, environment, bucket_start, cast(count(*) as bigint) as expected, cast(case when count(*) filter (where h <> 7) > 0 then count(*) filter (where h <> 7) end as bigint) as stored
from r group by all having count(*) filter (where h = 7) > 0"""


def averages(spark, d, name):
    spec = R.SPECS[name]
    return R.average(_minute(spark, d, spec), spec, list(spec.keys)[:1])


def _averages_sql(name):
    spec = R.SPECS[name]
    key, expr = list(spec.keys.items())[0]
    over = {"call_count": "count(*)", "duration_count": f"count(duration) filter (where {spec.duration_where})"}.get(spec.average_over) or f"sum(case when {spec.counters.get(spec.average_over)} then 1 else 0 end)"
    return f"select k as {key}, round(sum(duration) filter (where {spec.duration_where}) / cast(nullif({over}, 0) as double), 6) as avg_duration from (select *, {expr} as k from {records_sql(spec.source)} r0) r group by k"


def build() -> dict:
    out = {"p95_by_hour": (p95_by_hour, _p95_sql())}
    for name, spec in R.SPECS.items():
        src = records_sql(spec.source)
        out[f"a_{name}"] = (partial(_minute, spec=spec), R.aggregate_sql(spec, src))
        out[f"a_tier_hour_{name}"] = (partial(_tier, spec=spec, tier="hour"), R.aggregate_sql(spec, src, "hour"))
        out[f"a_tier_day_{name}"] = (partial(_tier, spec=spec, tier="day"), R.aggregate_sql(spec, src, "day"))
        out[f"a_merge_{name}"] = (partial(_merged, spec=spec), R.aggregate_sql(spec, src))
        if spec.has_histogram:
            out[f"a_hist_{name}"] = (partial(_hist, spec=spec), R.long_sql(spec, src, histogram.bin_sql("duration"), "bin", "n", "day"))
            out[f"a_dds_{name}"] = (partial(_sketch, spec=spec), R.long_sql(spec, src, sketch.index_sql("duration"), "idx", "cnt", "day"))
            out[f"q_pctl_{name}"] = (partial(percentiles, name=name), _percentiles_sql(name))
        if spec.has_duration:
            out[f"q_avg_{name}"] = (partial(averages, name=name), _averages_sql(name))
    wide = ", ".join(f"cast(sum(case when {histogram.bin_sql('duration')} = {i} then 1 else 0 end) as bigint) as hist_{i:02d}" for i in range(histogram.BINS))
    out["a_hist_wide"] = (
        lambda spark, d: R.histogram_wide(records(spark, d, "requests"), R.SPECS["req"], "day"),
        f"select coalesce(group_hash, '') as group_hash, date_trunc('day', created_at) as bucket_start, coalesce(environment, '') as environment, {wide} from {records_sql('requests')} r group by all",
    )
    out["q_pctl_bins"] = (mixed_percentiles, _mixed_sql())
    out["q_sketch_50"] = (narrow_rollup, _narrow_sql())
    out["q_sketch_all"] = (partial(narrow_rollup, grouped=False), _narrow_sql(False))
    out["j_drift"] = (drifted, _DRIFT_SQL)
    out["m_tier_sum"] = (tier_gaps, _TIER_GAPS_SQL)
    out["a_hpct"] = (hist_percentile, _hist_percentile_sql())
    out["a_dds_up"] = (upconverted, _upconverted_sql())
    out["a_dds_cnt"] = (sample_counts, f"select group_hash, count(duration) as samples from {records_sql('requests')} r group by 1")
    out["m_v1h"] = (
        covered,
        f"select group_hash, count(*) filter (where u) as samples, count(*) as mass, count(*) filter (where u) >= count(*) as covered from (select group_hash, queue <> '1-URGENT' or created_at >= timestamp '1995-01-01' as u from {records_sql('jobs')} r where attempt_id is not null and duration is not null) x group by 1",
    )
    out["a_dds_val"] = (
        lambda spark, d: sketch.add(records(spark, d, "requests"), []).select("idx", "cnt", F.round(sketch.value_of(F.col("idx")), 6).alias("value")),
        f"select idx, count(*) as cnt, round(case idx when -1 then 0.0 when 1261 then 86400000000 else 2 * pow(cast(101 as double) / 99, idx) / (cast(101 as double) / 99 + 1) end, 6) as value from (select {sketch.index_sql('duration')} as idx from {records_sql('requests')} r) group by idx",
    )
    return out
