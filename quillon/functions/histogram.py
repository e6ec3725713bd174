"""Log-spaced duration histogram: 39 bins between edges 128 * sqrt(2)**k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EDGES = tuple(round(128 * 2 ** (k / 2)) for k in range(38))
BINS = len(EDGES) + 1


def bin_of(duration: Column) -> Column:
    """Number of edges at or below the duration; null stays null."""
    at = F.lit(0)
    for e in EDGES:
        at = at + (duration >= e).cast("int")
    return at


def bin_sql(duration: str) -> str:
    return "(" + " + ".join(f"cast({duration} >= {e} as integer)" for e in EDGES) + ")"


def _edge(i: Column, shift: int) -> Column:
    return F.get(F.array(*[F.lit(e) for e in EDGES]), i + shift)


def percentile(bins: DataFrame, keys: list[str], p: float, bin_col="bin", count_col="n", low="min_duration", high="max_duration") -> DataFrame:
    """keys and estimate: rank walk over (keys, bin, n, min, max) rows.

    Within the crossing bin the value moves geometrically from edge to edge,
    narrowed to the observed range; the first bin is linear from 0 and the
    last without a maximum stays at its edge.
    """
    w = Window.partitionBy(*keys)
    walked = bins.where(F.col(count_col) > 0).withColumn("total", F.sum(count_col).over(w)).withColumn("upto", F.sum(count_col).over(w.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.greatest(F.ceil(F.col("total") * F.lit(p)), F.lit(1))
    crossing = walked.where((F.col("upto") >= rank) & (F.col("upto") - F.col(count_col) < rank))
    i = F.col(bin_col)
    lo = F.greatest(F.when(i == 0, 0).otherwise(_edge(i, -1)), F.col(low)).cast("double")
    hi = F.least(F.when(i < BINS - 1, _edge(i, 0)), F.col(high)).cast("double")
    within = (rank - (F.col("upto") - F.col(count_col))) / F.col(count_col)
    top = F.greatest(hi, lo)
    estimate = F.when(hi.isNull(), lo).when(lo > 0, lo * F.pow(top / lo, within)).otherwise(top * within)
    return crossing.select(*keys, estimate.alias("estimate"))
