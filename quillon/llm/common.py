"""Shared helpers: cluster-visible scratch tables, byte hashing, Arrow access."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows that go to a Python worker at once, where the session has no number of
#: its own: documents are long, and both sides hold such a batch beside the heap.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a session."""
    context = spark.sparkContext
    if not context.getConf().contains(_BATCH_CONF) and spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    if getattr(context, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.joinpath("quillon").rglob("*.py")):
            z.write(source, source.relative_to(root))
    context.addPyFile(str(archive))  # the driver serves the file; executors need not share its folder
    context._quillon_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; Python workers can import this package then."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Intermediate Parquet tables in the folder that the cluster shares.

    The folder is spark.checkpoint.dir. Only a local session without that
    setting, as in tests, gets a temporary folder of its own; on a cluster a
    missing setting is an error, as executors do not share their disks. Tables
    written here cut lineage and survive the loss of executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillon-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        """df written as Parquet and read again. Large bytes are worth "zstd", which takes more memory outside the heap."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", compression).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._quillon_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in kept:
            path = jvm.org.apache.hadoop.fs.Path(df._quillon_path)
            path.getFileSystem(conf).delete(path, True)


# 64-bit finaliser of murmur3 (public domain), fixed values.
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_INVERSE = pow(BASE, -1, 1 << 64)
WORD_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(WORD_SEPARATORS)] = False
# Masks that keep so many leading bytes of a little-endian word.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def powers(n: int, kind: str = "up") -> np.ndarray:
    """BASE**i (up) or BASE**-i (down) modulo 2**64 for i below n."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), np.uint64(BASE if kind == "up" else _INVERSE))
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def seeds(n: int, seed: int, dtype=np.uint64) -> np.ndarray:
    """n odd multipliers, the same in every process."""
    x = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))
    return (x >> np.uint64(64 - 8 * np.dtype(dtype).itemsize)).astype(dtype) | dtype(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int):
    """Ranges of rows of about `most` bytes each; a longer row is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words of some rows, and the bytes after their last."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _IS_WORD[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    first = inside & ~before
    ends = np.empty(n, bool)
    ends[-1] = True
    ends[:-1] = ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(inside & ends) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some rows, A-Z lower-cased if fold, and each row's first word.

    Each eight bytes of a word are scrambled with their place in it before they
    are summed, so that no regular pattern of letters cancels out; equal words
    have equal hashes wherever they stand.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data] if fold else data
    size = ends - starts
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    nth = np.arange(first[-1] + blocks[-1]) - np.repeat(first, blocks)
    left = np.repeat(size, blocks) - 8 * nth
    x = np.ndarray(n + 1, "<u8", padded, strides=(1,))[np.repeat(starts, blocks) + 8 * nth]
    x &= _TAIL[np.minimum(left, 8)]
    x = mix(x ^ mix((nth + 1).astype(np.uint64) * np.uint64(BASE)))
    return mix(np.add.reduceat(x, first) + size.astype(np.uint64)), np.searchsorted(starts, offsets)


_SHINGLE = seeds(5, 11)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; with fewer words, of all as one."""
    words, at = word_hashes(data, offsets)
    n = max(len(words) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * _SHINGLE[k]
    rolled = mix(rolled)
    found = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            x = np.sort(rolled[a : b - width + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            x = mix((words[a:b] * _SHINGLE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            x = rolled[:0]
        found.append(x)
    return found
