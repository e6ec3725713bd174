"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the K least hashes of a text's distinct five-word shingles. The
sketch of a union of parts is the K least hashes of the parts' sketches, so
sketches merge. Two sketches estimate resemblance, containment and distinct
shingle counts; a set of at most K shingles is kept whole and is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import common
from quillon.llm.common import Scratch

K, HASH_BYTES = 128, 6
#: Bytes of text in a range of neighbours, and the most ranges.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16
CHUNK = 1 << 20
_SPACE = float(1 << 8 * HASH_BYTES)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least of sorted distinct 64-bit hashes, cut to their leading bytes."""
    return hashes[:k] >> np.uint64(64 - 8 * HASH_BYTES)


def to_text(values: np.ndarray) -> str:
    raw = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :]
    return base64.b64encode(raw.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - HASH_BYTES :] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the parts' sets."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPACE / float(a[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A n B| / |A u B|; two empty sets resemble wholly."""
    union = merge([a, b], k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union)) if len(union) else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A n B| / |A|; an empty A is contained in anything."""
    n = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge([a, b], k), k) / n) if n else 1.0


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    return [sketch(x) for x in common.shingles(data, np.cumsum([0] + [len(t) for t in texts]))]


def _fingerprint(batches):
    for batch in batches:
        data, off = common.text_bytes(batch.column(1))
        for i, j in common.slices(off, CHUNK):
            found = [to_text(sketch(x)) for x in common.shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.string())], names=["id", "fingerprint"])


def fingerprint(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id and fingerprint of each whole text; null, empty and blank texts have ''."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprint, "id bigint, fingerprint string").withColumnRenamed("id", id_col)


def merge_fingerprints(parts: DataFrame, key_col: str, fingerprint_col: str = "fingerprint", salts: int = 64) -> DataFrame:
    """key and merged fingerprint of its parts; hot keys merge in salted steps."""

    @F.pandas_udf("string")
    def merged(values: pd.Series) -> str:
        out = np.zeros(0, np.uint64)
        for start in range(0, len(values), 1000):
            out = merge([out, *(from_text(v) for v in values.iloc[start : start + 1000].dropna())])
        return to_text(out)

    salted = parts.select(F.col(key_col).alias("k"), F.col(fingerprint_col).alias("f"), (F.abs(F.xxhash64(fingerprint_col)) % salts).alias("s"))
    return salted.groupBy("k", "s").agg(merged("f").alias("f")).groupBy("k").agg(merged("f").alias(fingerprint_col)).withColumnRenamed("k", key_col)


_NEXT = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches):
    """Rows sorted by bucket and order; compares each with the next of its bucket."""
    last = None  # (bucket, id, text, sketch, whether it is a copy)
    for batch in batches:
        bucket, extra, ids = (batch.column(k).to_pylist() for k in range(3))
        _, off = common.text_bytes(batch.column(3))
        for i, j in common.slices(off, CHUNK):
            texts = [t or "" for t in batch.column(3).slice(i, j - i).to_pylist()]
            own = sketches([t.encode() for t in texts])
            rows = ([last] if last else []) + list(zip(bucket[i:j], ids[i:j], texts, own, extra[i:j]))
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[4]]
            edited = [a[2][: len(a[2]) - len(a[2]) // 2] + b[2][: len(a[2]) // 2] for a, b in pairs]
            coded = [e.encode() for e in edited]
            out = []
            for (a, b), e, raw in zip(pairs, sketches(coded), coded):
                out.append((a[1], len(a[2]), hashlib.sha256(raw).hexdigest(), to_text(a[3]), to_text(e), resemblance(a[3], e), resemblance(a[3], b[3])))
            last = rows[-1]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


_KEYS = np.dtype([("o", ">u8"), ("th", ">u8")])


def _order(o: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Pairs of signed numbers as strings of bytes that sort as they do."""
    keys = np.empty(len(o), _KEYS)
    for name, x in (("o", o), ("th", th)):
        keys[name] = x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return keys.view("S16")


def _ranges(bounds: np.ndarray):
    """A column function: for each row its range and, where it starts a range, a copy for the one before.

    bounds are the ranges' first keys, ascending; the places are 2 * range, and
    2 * range + 1 for a copy. Rows of one key that starts several ranges are
    dealt out over them in turn. One copy a task is enough.
    """

    def run(batches):
        copied: set[int] = set()
        turn = 0
        for o, th in batches:
            keys = _order(o.to_numpy(), th.to_numpy())
            low, high = np.searchsorted(bounds, keys, side="left"), np.searchsorted(bounds, keys, side="right")
            out = [[2 * (h - 1)] for h in high.tolist()]
            for k in np.flatnonzero(high > low).tolist():
                out[k] = [2 * (int(low[k]) + turn % int(high[k] - low[k]))]
                turn += 1
                for j in range(int(low[k]), int(high[k])):
                    if j not in copied:
                        copied.add(j)
                        out[k].append(2 * ((j - 1) % len(bounds)) + 1)
            yield pd.Series(out)

    return run


def compare_neighbours(docs: DataFrame, id_col="doc_id", text_col="text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next one's.

    The next document is the following one by id, and the first after the
    last; rows that repeat an id follow each other by a hash of the text; null
    ids come first. The edited text is the text with its last n_chars // 2 code
    points replaced by as many of the next text's first, or all it has. Null
    texts are empty. Other columns are ignored; an empty table gives no rows.

    Keys alone (an id and a hash of the text) are sorted into ranges of about
    range_bytes of text, whatever the ids look like; the ranges' first keys, at
    most MOST_RANGES, go to every task. Texts then move once, to their range;
    the last row of one meets a copy of the first row of the next. Rows of
    equal id and text are alike, so that many of them spread over ranges.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(order.alias("o"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    keys = scratch.keep(rows.select("o", "th", F.octet_length("text").alias("size"), F.monotonically_increasing_id().alias("tie")))
    count = min(max(1, -(-(keys.agg(F.sum("size")).first()[0] or 0) // range_bytes)), MOST_RANGES)
    firsts = keys.select("o", "th", "tie").repartitionByRange(count, "o", "th", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("o", "th", "tie")).alias("f"))
    firsts = sorted(tuple(r["f"]) for r in firsts.collect())
    scratch.drop(keys)
    bounds = _order(np.array([f[0] for f in firsts], np.int64), np.array([f[1] for f in firsts], np.int64))

    @F.pandas_udf("array<int>")
    def places(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return _ranges(bounds)(parts)

    spread = rows.withColumn("place", F.explode(places("o", "th"))).select(F.expr("place div 2").cast("long").alias("b"), (F.col("place") % 2).alias("extra"), "id", "text", "o", "th")
    sorted_rows = spread.repartition(count, "b").sortWithinPartitions("b", "extra", "o", "th").select("b", (F.col("extra") == 1).alias("extra"), "id", "text")
    return sorted_rows.mapInArrow(_compare, _NEXT).withColumnRenamed("id", id_col)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(common.read(spark, sf_dir, "documents"))
