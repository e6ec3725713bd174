"""Relative-error duration sketch: logarithmic buckets of 1 % accuracy.

A sketch is rows (keys, idx, cnt); merging is a sum by idx, which partial
aggregation does map-side. The packed form is only for interchange.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.histogram import EDGES

ALPHA_INVERSE = 100
GAMMA = 101 / 99
UNDERFLOW, LAST, OVERFLOW = -1, 1260, 1261
MAX_VALUE = 86_400_000_000  # a day in microseconds
_GAMMA_SQL = "(cast(101 as double) / 99)"


def index_of(v: Column) -> Column:
    ln = F.ln(F.lit(101.0) / F.lit(99))
    return F.when(v < 1, UNDERFLOW).when(v > MAX_VALUE, OVERFLOW).otherwise(F.least(F.greatest(F.ceil(F.ln(v.cast("double")) / ln), F.lit(0)), F.lit(LAST))).cast("int")


def index_sql(v: str) -> str:
    return f"cast(case when {v} < 1 then {UNDERFLOW} when {v} > {MAX_VALUE} then {OVERFLOW} else least(greatest(ceil(ln(cast({v} as double)) / ln({_GAMMA_SQL})), 0), {LAST}) end as integer)"


def index(v: float) -> int:
    if v < 1:
        return UNDERFLOW
    return OVERFLOW if v > MAX_VALUE else min(max(math.ceil(math.log(v) / math.log(GAMMA)), 0), LAST)


def value_of(i: Column) -> Column:
    """Representative value of a bucket, 0 below the first and a day above the last."""
    g = F.lit(101.0) / F.lit(99)
    return F.when(i == UNDERFLOW, 0.0).when(i == OVERFLOW, float(MAX_VALUE)).otherwise(2 * F.pow(g, i) / (g + 1))


def add(df: DataFrame, keys: list[str], duration: str = "duration") -> DataFrame:
    """Rows (keys, idx, cnt) of the non-null durations."""
    return df.where(F.col(duration).isNotNull()).groupBy(*keys, index_of(F.col(duration)).alias("idx")).agg(F.count("*").alias("cnt"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "idx").agg(F.sum("cnt").alias("cnt"))


def add_ranged(df: DataFrame, keys: list[str], duration: str = "duration") -> DataFrame:
    """Rows (keys, idx, cnt, min_duration, max_duration) of the non-null durations; the range is the cell's own."""
    cells = df.where(F.col(duration).isNotNull()).groupBy(*keys, index_of(F.col(duration)).alias("idx"))
    return cells.agg(F.count("*").alias("cnt"), F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration"))


def with_bins(sketches: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, cnt): sketches, and for keys that have none their histogram bins (keys, bin, n) moved into sketch buckets."""
    bare = bins.join(sketches.select(*keys).distinct(), keys, "left_anti")
    moved = bare.groupBy(*keys, upconverted().alias("idx")).agg(F.sum("n").alias("cnt"))
    return sketches.select(*keys, "idx", "cnt").unionByName(moved)


def percentile(sketches: DataFrame, keys: list[str], p: float, low="min_duration", high="max_duration") -> DataFrame:
    """keys and estimate from rows (keys, idx, cnt, min, max), clamped to the range."""
    return percentiles(sketches, keys, [p], low, high).drop("q")


def percentiles(sketches: DataFrame, keys: list[str], ps, low="min_duration", high="max_duration") -> DataFrame:
    """(keys, q, estimate) of several quantiles in one walk over the cells; the range is the least and most of a key's cells."""
    w = Window.partitionBy(*keys)
    walked = sketches.where("cnt > 0").withColumn("total", F.sum("cnt").over(w)).withColumn("upto", F.sum("cnt").over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    walked = walked.withColumn(low, F.min(low).over(w)).withColumn(high, F.max(high).over(w))
    asked = F.array(*[F.struct(F.lit(float(p)).alias("q"), F.greatest(F.ceil(F.col("total") * F.lit(p)), F.lit(1)).alias("rank")) for p in ps])
    crossed = F.filter(asked, lambda x: (F.col("upto") >= x["rank"]) & (F.col("upto") - F.col("cnt") < x["rank"]))
    crossing = walked.withColumn("_q", F.explode(crossed)).withColumn("q", F.col("_q.q"))
    rank = F.col("_q.rank")
    g, i = F.lit(101.0) / F.lit(99), F.col("idx")
    lower = F.when(i == UNDERFLOW, 0.0).when(i == OVERFLOW, float(MAX_VALUE)).otherwise(F.pow(g, i - 1))
    upper = F.when(i == UNDERFLOW, 1.0).when(i == OVERFLOW, float(MAX_VALUE)).otherwise(F.pow(g, i))
    lo, hi = F.greatest(lower, F.col(low).cast("double")), F.least(upper, F.col(high).cast("double"))
    top = F.greatest(hi, lo)
    within = (rank - (F.col("upto") - F.col("cnt"))) / F.col("cnt")
    estimate = F.when(lo > 0, lo * F.pow(top / lo, within)).otherwise(top * within)
    return crossing.select(*keys, "q", F.least(F.greatest(estimate, F.col(low).cast("double")), F.col(high).cast("double")).alias("estimate"))


def percentile_sql(source: str, keys: str, p: float) -> str:
    """The same estimate over a SQL relation (keys, idx, cnt, min_duration, max_duration)."""
    return f"""
select {keys}, least(greatest(case when lo > 0 then lo * pow(greatest(hi, lo) / lo, within) else greatest(hi, lo) * within end, min_duration), max_duration) as estimate from (
  select *, greatest(case idx when {UNDERFLOW} then 0.0 when {OVERFLOW} then {MAX_VALUE} else pow({_GAMMA_SQL}, idx - 1) end, cast(min_duration as double)) as lo,
    least(case idx when {UNDERFLOW} then 1.0 when {OVERFLOW} then {MAX_VALUE} else pow({_GAMMA_SQL}, idx) end, cast(max_duration as double)) as hi,
    (rank - (upto - cnt)) / cast(cnt as double) as within
  from (select *, greatest(ceil(total * cast({p} as double)), 1) as rank from (
    select *, sum(cnt) over (partition by {keys}) as total, sum(cnt) over (partition by {keys} order by idx rows unbounded preceding) as upto from {source}))
  where upto >= rank and upto - cnt < rank)"""


def upconverted(bin_col: str = "bin") -> Column:
    """Sketch bucket that a histogram bin's mass moves to: its geometric mean."""
    middles = [EDGES[0] / 2, *(math.sqrt(a * b) for a, b in zip(EDGES, EDGES[1:])), EDGES[-1]]
    return F.get(F.array(*[F.lit(index(m)) for m in middles]), F.col(bin_col))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(128 | n & 127)
        n >>= 7
    return bytes([*out, n])


def pack(counts: dict[int, int]) -> bytes:
    """Index deltas and counts as varints, in index order; empty counts vanish."""
    out, before = bytearray(), UNDERFLOW
    for i, n in sorted(counts.items()):
        if n > 0:
            out += _varint(i - before) + _varint(n)
            before = i
    return bytes(out)


def unpack(data: bytes) -> dict[int, int]:
    """Raises ValueError where the data end within a number or a pair."""
    numbers, n, shift = [], 0, 0
    for byte in data:
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            numbers.append(n)
            n = shift = 0
    if shift or len(numbers) % 2:
        raise ValueError("truncated sketch")
    out, at = {}, UNDERFLOW
    for delta, count in zip(numbers[::2], numbers[1::2]):
        at += delta
        out[at] = out.get(at, 0) + count
    return out


def packed(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the packed bytes, one row a sketch."""

    @F.pandas_udf("binary")
    def code(indices: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([pack(dict(zip(map(int, i), map(int, n)))) for i, n in zip(indices, counts)], dtype=object)

    cells = F.array_sort(F.collect_list(F.struct("idx", "cnt")))  # at most OVERFLOW + 2 cells a sketch
    listed = sketches.groupBy(*keys).agg(cells.alias("_cells"))
    return listed.select(*keys, code(F.col("_cells.idx"), F.col("_cells.cnt")).alias("sketch"))


def sample_count(sketch: Column) -> Column:
    """Samples in a packed sketch; null where it is truncated."""

    @F.pandas_udf("bigint")
    def count(data: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return None if raw is None else sum(unpack(bytes(raw)).values())
            except ValueError:
                return None

        return pd.Series([one(x) for x in data], dtype="Int64")

    return count(sketch)
