"""Toxicity: averaged subword embeddings under a linear softmax.

A text is the bag of its words' byte 3-, 4- and 5-grams (A-Z lower-cased, one
space standing for each word end), hashed into 2**15 buckets. The mean of the
buckets' embeddings goes through a linear softmax; both are trained jointly by
numpy on the driver from a bounded sample of labelled rows. A misspelled word
shares most of its grams with the word it hides. As the model is linear behind
the mean, a bucket's embedding folds into one number for scoring.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import common

BUCKETS_LOG2, DIM, GRAMS = 15, 8, (3, 4, 5)
#: The classifier is fitted on at most so many labelled rows of each class,
#: taken in the order of a hash of their ids.
SAMPLE_PER_CLASS = 1000
#: Their texts have at most so many bytes together; one that would go beyond is
#: passed over for the next.
SAMPLE_BYTES = 32 << 20
#: Rows that the fit spreads out at a time.
DENSE_ROWS = 64
EPOCHS, RATE, DECAY = 100, 0.1, 1e-4
CHUNK = 1 << 20
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[65:91] += 32
_SPACE[list(common.WORD_SEPARATORS)] = 32
_MUL = np.uint32(0x01000193)
_FIN = np.uint32(0x9E3779B1)


def gram_buckets(data: np.ndarray, offsets: np.ndarray):
    """For each gram size: buckets and validity at each byte of padded rows.

    Rows get a space at both ends; gram k of a row starts at byte k of it. A
    gram counts where only its ends may be spaces and one byte is not a space.
    Also returns where each padded row starts.
    """
    n = len(offsets) - 1
    at = offsets + 2 * np.arange(n + 1)
    padded = np.full(at[-1] + max(GRAMS), 32, np.uint8)
    spot = np.ones(at[-1], bool)
    spot[at[:-1]] = spot[at[1:] - 1] = False
    padded[: at[-1]][spot] = _SPACE[data]
    size = int(at[-1])
    space = padded == 32
    starts = np.zeros(len(padded) + 1, bool)
    starts[at[:-1]] = True
    wide = padded.astype(np.uint32)
    h, scale = wide[:size].copy(), np.uint32(1)
    clear, out = None, []
    for k in range(1, max(GRAMS)):
        scale = np.uint32((int(scale) * int(_MUL)) & 0xFFFFFFFF)
        h = h + wide[k : k + size] * scale
        if k >= 2:
            inner = ~space[k - 1 : k - 1 + size]
            clear = inner if clear is None else clear & inner
        if k + 1 in GRAMS:
            x = (h ^ (h >> np.uint32(15))) * _FIN
            x ^= x >> np.uint32(13)
            x = x * _MUL + np.uint32(k)
            out.append((x * _FIN >> np.uint32(32 - BUCKETS_LOG2), clear & ~starts[k : k + size]))
    return out, at


def dense(rows: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> np.ndarray:
    """Sparse rows (buckets, shares) spread out."""
    out = np.zeros((len(rows), buckets), np.float32)
    for row, (at, share) in zip(out, rows):
        row[at] = share
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, prior: float, epochs: int = EPOCHS, buckets: int = 1 << BUCKETS_LOG2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket embeddings, softmax weights and biases from rows of mean gram counts.

    Embeddings and softmax weights move together by Adam on the class-balanced
    cross entropy; the bias then shifts to the given share of toxic rows.
    """
    rng = np.random.default_rng(8)
    scale = np.float32(np.sqrt(buckets))
    e = rng.normal(0, 0.1, (buckets, DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    share = np.array([max((toxic == c).sum(), 1) for c in (0, 1)], np.float32)
    weight = (0.5 / share[toxic.astype(int)]).astype(np.float32)
    target = np.eye(2, dtype=np.float32)[toxic.astype(int)]
    params = [e, w, b]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, epochs + 1):
        grads = [DECAY * e, DECAY * w, np.zeros_like(b)]
        for i in range(0, len(rows), DENSE_ROWS):
            own = slice(i, i + DENSE_ROWS)
            counts = dense(rows[own], buckets)
            hidden = (counts @ e) * scale
            z = hidden @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[own]) * weight[own, None]
            for total, more in zip(grads, ((counts.T @ (g @ w.T)) * scale, hidden.T @ g, g.sum(axis=0))):
                total += more
        for i, (q, d) in enumerate(zip(params, grads)):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            q -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    b[1] += np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    return e * scale, w, b


def fold(e: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """One number for each bucket and a bias: the log odds are linear in the mean embedding."""
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])


def row_counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean gram counts of whole texts as sparse rows that sum to 1, or empty without grams."""
    out = []
    for t in texts:
        grams, _ = gram_buckets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        at, n = np.unique(np.concatenate([x[ok] for x, ok in grams]), return_counts=True)
        out.append((at.astype(np.uint16), (n / max(n.sum(), 1)).astype(np.float32)))
    return out


def scorer(folded: np.ndarray, bias: float):
    """A mapInArrow function from (id, text) to (id, score)."""

    def score(batches):
        for batch in batches:
            data, off = common.text_bytes(batch.column(1))
            for i, j in common.slices(off, CHUNK):
                grams, at = gram_buckets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                total, n = np.zeros(at[-1], np.float32), np.zeros(at[-1], np.int32)
                for x, ok in grams:
                    total += np.where(ok, folded[x], np.float32(0))
                    n += ok
                s = np.add.reduceat(total, at[:-1], dtype=np.float64)
                c = np.add.reduceat(n, at[:-1], dtype=np.int64)
                z = np.clip(s / np.maximum(c, 1) + bias, -500, 500)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-z)))], names=["id", "score"])

    return score


def in_fold(id_col, folds: int = 5):
    """crc32 of the id as text, modulo the number of folds, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> tuple[np.ndarray, float]:
    """Fits on labelled rows outside the held-out fold; see SAMPLE_PER_CLASS.

    Ids labelled more than once count once, as toxic if any label says so; of
    documents that repeat an id, the text of the least hash is taken; null ids
    and labels are left out. Without rows of both classes every score is the
    share of toxic labels.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(~in_fold("id")).groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    if share in (None, 0.0, 1.0):
        return _constant(share or 0.0)
    order = [F.xxhash64("id"), F.col("id")]
    picked = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(*order).limit(SAMPLE_PER_CLASS).collect()]
    sample = spark.createDataFrame([(r["id"], r["y"]) for r in picked], "id bigint, y int")  # 2 * SAMPLE_PER_CLASS short rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = texts.join(F.broadcast(sample), "id")
    sized = found.groupBy("id", "y").agg(F.min(F.struct("th", F.octet_length("text").alias("size"))).alias("m")).select("id", "y", "m.*").collect()
    room, chosen = SAMPLE_BYTES, {}
    for r in sorted(sized, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"])):
        if r["size"] <= room:
            room -= r["size"]
            chosen[r["id"], r["th"]] = r["y"]
    picks = spark.createDataFrame(list(chosen), "id bigint, th bigint")
    rows = {(r["id"], r["th"]): r["text"] for r in texts.join(F.broadcast(picks), ["id", "th"]).dropDuplicates(["id", "th"]).collect()}
    keys = sorted(rows)
    y = np.array([chosen[k] for k in keys], bool)
    if y.all() or not y.any():
        return _constant(share)
    return fold(*fit(row_counts([rows[k].encode() for k in keys]), y, share))


def _constant(share: float) -> tuple[np.ndarray, float]:
    return np.zeros(1 << BUCKETS_LOG2, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Null and empty texts score as the model's bias alone. A null id is scored
    as any other and counts as held out, as an id of "" has the remainder 0;
    nothing is learnt from it. A score of 0.5 is predicted toxic. Repeated rows
    are each scored; other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(scorer(*model), "id bigint, score double")
    return scored.select(F.col("id").alias(id_col), in_fold("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, common.read(spark, sf_dir, "labels")))


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], text_col="text") -> DataFrame:
    """docs, all columns, without the rows whose score is 0.5 or more.

    Null and empty texts score as the model's bias alone; null ids and repeated
    rows are scored each for its own text; an empty table stays empty.
    """
    score, place = scorer(*model), docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            text = batch.column(place)
            scored = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), text], names=["id", "text"])
            scores = np.concatenate([s.column(1).to_numpy() for s in score([scored])] or [np.zeros(0)])
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(keep, docs.schema)
