"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell of (source, language, topic). Raking scales the
cells until each marginal has its target share of all tokens; the ratio of a
cell's fitted to its own share, over the largest ratio, is the probability by
which its documents are sampled, so that expected kept tokens have the targets'
marginals.

Topics come from a latent semantic analysis of all documents. A text is a unit
vector of its words' hashed counts; the second moments of all vectors are
summed in whole numbers, so that no order of sums matters; the leading
directions of that matrix, apart from the mean one, are the topics' axes, and
a text's topic is the end of the axis on which it lies farthest out.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from quillon.llm import common
from quillon.llm.common import Scratch

#: Without given targets, shares are own shares to this power: rare values gain, none vanishes.
TEMPERATURE = 0.9
#: Raking ends where a sweep changes no marginal value by more than this share
#: of its target, or, where no weights meet all targets at once, where the
#: largest change no longer falls by STALL of itself. SWEEPS is a guard.
TOLERANCE, STALL, SWEEPS = 5e-3, 1e-3, 200
DIMENSIONS = ("source", "lang", "topic")
#: Buckets of hashed words, axes of topics, and the length of a unit vector.
BUCKETS, AXES, UNIT = 128, 4, 1024
CHUNK = 1 << 20


def _vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounded vectors of damped word counts, UNIT long, and the numbers of words."""
    words, first = common.word_hashes(data, offsets)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    x = np.sqrt(np.bincount(row * BUCKETS + (words >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=n * BUCKETS).reshape(n, BUCKETS))
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.rint(x * (UNIT / np.maximum(length, 1))), np.diff(first)


def _moments(batches):
    total = np.zeros((BUCKETS, BUCKETS), np.int64)
    for batch in batches:
        data, off = common.text_bytes(batch.column(0))
        for i, j in common.slices(off, CHUNK):
            x, _ = _vectors(data[off[i] : off[j]], off[i : j + 1] - off[i])
            total += np.rint(x.T @ x).astype(np.int64)  # exact: far below 2**53
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["at", "n"])


def topic_axes(docs: DataFrame, text_col="text") -> np.ndarray:
    """BUCKETS by AXES: the topics' axes, from the second moments of all texts."""
    sums = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(_moments, "at int, n bigint")
    moments = np.zeros(BUCKETS * BUCKETS)
    for r in sums.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # at most BUCKETS * BUCKETS rows
        moments[r["at"]] = float(r["n"])
    _, vectors = np.linalg.eigh(moments.reshape(BUCKETS, BUCKETS))
    axes = vectors[:, ::-1][:, 1 : AXES + 1]
    return np.round(axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(AXES)]), 9)


def _topics(axes: np.ndarray):
    def run(batches):
        for batch in batches:
            data, off = common.text_bytes(batch.column(batch.num_columns - 1))
            for i, j in common.slices(off, CHUNK):
                x, n = _vectors(data[off[i] : off[j]], off[i : j + 1] - off[i])
                score = np.round(x @ axes, 6)
                axis = np.abs(score).argmax(axis=1)
                far = score[np.arange(len(axis)), axis] < 0
                names = [None if not words else f"t{2 * a + low}" for a, low, words in zip(axis.tolist(), far.tolist(), n.tolist())]
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(names, pa.string()), pa.array(n, pa.int64())], names=[*own.schema.names[:-1], "topic", "tokens"])

    return run


def uniform(id_col: Column) -> Column:
    """A number in [0, 1) from the md5 of the id as text."""
    head = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(head, 16, 10).cast("long") / F.lit(float(1 << 52))


@dataclass
class Fitted:
    """Cells (source, lang, topic, tokens, p), the sweeps that raking took, and the largest
    gap between a marginal value and its target, as a share of the target."""

    cells: DataFrame
    sweeps: int
    gap: float


def target_shares(cells: DataFrame, given: DataFrame | None, dimension: str, temperature: float) -> DataFrame:
    """(dimension, t): target shares that sum to 1, of values that have tokens.

    given has (value, weight); its null value means documents without one.
    Values that it lacks, or weighs 0 or less, get no share.
    """
    own = cells.groupBy(dimension).agg(F.sum("tokens").alias("n"))
    if given is None:
        shares = own.select(dimension, F.pow(F.col("n").cast("double"), F.lit(temperature)).alias("t"))
    else:
        listed = given.groupBy(_key(F.col("value")).alias(dimension)).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("t"))
        shares = own.join(listed, dimension, "left").select(dimension, F.coalesce("t", F.lit(0.0)).alias("t"))
    total = shares.agg(F.sum(F.round("t", 12).cast("decimal(38,12)")).cast("double").alias("s")).first()["s"]
    if not total and given is not None and not own.isEmpty():
        raise ValueError(f"the targets of {dimension} name no value that has tokens")
    return shares.select(dimension, (F.col("t") / F.lit(total or 1.0)).alias("t"))


def rake(cells: DataFrame, scratch: Scratch, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> Fitted:
    """Scales the cells to each marginal in turn, one aggregate and join for each.

    Marginals that no weights of these cells can meet at once leave a gap,
    which is returned; the write of a sweep's last table measures it. Sums are
    rounded, so that their order decides nothing. Without cells nothing is raked.
    """
    tokens = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    total = tokens or 1
    added = lambda c: F.sum(F.round(c, 18).cast("decimal(38,18)")).cast("double")
    now, gap, done = cells, float("inf") if tokens else 0.0, 0
    for d in DIMENSIONS:
        now = now.join(targets[d].withColumnRenamed("t", f"t_{d}"), d)
    now = now.withColumn("w", F.col("tokens") / F.lit(float(total)))
    columns, before = now.columns, []
    while tokens and done < sweeps:
        now, seen = now.select(columns), Observation()
        for d in DIMENSIONS:  # a table for each, so that plans stay short
            factor = now.groupBy(d, f"t_{d}").agg(added("w").alias("s")).select(d, F.when(F.col("s") > 0, F.col(f"t_{d}") / F.col("s")).otherwise(0.0).alias(f"f_{d}"))
            scaled = now.join(factor, d).withColumn("w", F.col("w") * F.col(f"f_{d}"))
            if d == DIMENSIONS[-1]:
                off = F.greatest(*[F.abs(F.col(f"f_{x}") - 1) for x in DIMENSIONS])
                scaled = scaled.observe(seen, F.max(F.when(F.col("w") > 0, off)).alias("gap"))
            scaled = scratch.keep(scaled)
            scratch.drop(*before)
            now, before = scaled, [scaled]
        done += 1
        last, gap = gap, seen.get["gap"] or 0.0
        if gap <= tolerance or (done > 2 and gap > (1 - STALL) * last):
            break
    logging.getLogger(__name__).info("raked in %d sweeps, largest gap %.2g of a target", done, gap)
    ratio = now.withColumn("ratio", F.col("w") * F.lit(float(total)) / F.col("tokens"))
    most = ratio.agg(F.max("ratio")).first()[0] or 1.0
    fitted = scratch.keep(ratio.select(*DIMENSIONS, "tokens", F.round(F.col("ratio") / F.lit(most), 12).alias("p")))
    return Fitted(fitted, done, gap)


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def fit_cells(docs: DataFrame, axes: np.ndarray, scratch: Scratch, source_col="source", lang_col="lang", text_col="text", targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, tolerance: float = TOLERANCE) -> Fitted:
    """Raked cells of docs; targets gives (value, weight) tables by dimension, others are tempered own shares."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    light = docs.select(_key(F.col(f"`{source_col}`")).alias("source"), _key(F.col(f"`{lang_col}`")).alias("lang"), text.alias("text")).mapInArrow(_topics(axes), "source string, lang string, topic string, tokens bigint")
    cells = scratch.keep(light.where("tokens > 0").withColumn("topic", _key(F.col("topic"))).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    shares = {d: scratch.keep(target_shares(cells, (targets or {}).get(d), d, temperature)) for d in DIMENSIONS}
    return rake(cells, scratch, shares, tolerance)


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", lang_col="lang", targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, tolerance: float = TOLERANCE, keep_text: bool = True) -> DataFrame:
    """docs with the added columns mix_topic, mix_tokens, mix_p and mix_kept.

    targets may give a table (value, weight) for each of source, lang and
    topic; values that a given table lacks are not sampled. Without one, own
    shares to the power `temperature` are the target. A document is sampled
    if a hash of its id falls below its cell's probability; equal ids fare
    alike. Null source and lang are values of their own. Null, empty and blank
    texts have no tokens and no topic: they are in no cell, get p 1 and stay.
    An empty table stays empty. Without keep_text the text column is left out.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    axes = topic_axes(docs.select(F.col(f"`{text_col}`").alias("text")))
    fitted = fit_cells(docs, axes, scratch, source_col, lang_col, text_col, targets, temperature, tolerance)
    kept_cols = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept_cols]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    added = [T.StructField("topic", T.StringType()), T.StructField("tokens", T.LongType())]
    keyed = rows.mapInArrow(_topics(axes), T.StructType([rows.schema["row"], *added]))
    keyed = keyed.select("row", "topic", "tokens", _key(F.col(f"row.`{source_col}`")).alias("_s"), _key(F.col(f"row.`{lang_col}`")).alias("_l"), _key(F.col("topic")).alias("_t"))
    p = fitted.cells.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), "p")
    # cells whose table Spark finds small meet the texts where they are; else both are shuffled
    out = keyed.join(p, ["_s", "_l", "_t"], "left").withColumn("p", F.when(F.col("tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(1.0))
    kept = uniform(F.col(f"row.`{id_col}`")) < F.col("p")
    return out.select("row.*", F.col("topic").alias("mix_topic"), F.col("tokens").alias("mix_tokens"), F.col("p").alias("mix_p"), kept.alias("mix_kept"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.read(spark, sf_dir, "documents"), keep_text=False)
    return mixed.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_p", 9).alias("p"), F.col("mix_kept").alias("kept"))
