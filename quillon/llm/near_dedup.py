"""MinHash near-duplicates: banded candidates, odd sketches, exact checks.

Every text becomes its set of distinct five-word shingles. Texts with equal
sets collapse to one class. A class gets 128 MinHash samples, cut into 32
bands of 4, and an odd sketch: the samples are hashed into a 512-bit parity
bitmap, so that the population count of two sketches' XOR estimates how many
samples differ, and from it the resemblance, most precisely where it is high.
Bucket mates whose sketches look alike are compared on their full sets.

Pairs at resemblance 0.75 share no band with probability (1 - .75**4)**32,
about 5e-6; sketches reject only estimates below 0.5, some 5 deviations off.

No bucket is expanded into all its pairs. First, each member meets the
bucket's smallest id only; the confirmed links' components then label the
members. Second, members of other labels than the bucket's commonest meet all
members of different labels. Pairs of one label need no check: they are
already connected. Buckets of any size go the same way: blocks of at most
BLOCK by BLOCK members compare their sketches, and what looks alike in a part
of a block compares its full sets there, so that only links leave it. Every
candidate link between components is tested, and a bucket of n copies costs
about n comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import common
from quillon.llm.common import Scratch
from quillon.llm.components import components

BANDS, ROWS, SKETCH_BITS, LEAST_ESTIMATE = 32, 4, 512, 0.5
SAMPLES = BANDS * ROWS
CHUNK = 1 << 20
#: Members on each side of a block of sketches, and of a part of it that compares full sets.
BLOCK, PART = 1024, 256


def signatures(sets: list[np.ndarray], samples: int = SAMPLES) -> np.ndarray:
    """MinHash samples (uint32) of nonempty sets of uint64, one row a set."""
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    a, b = common.seeds(samples, 101, np.uint32), common.seeds(samples, 202, np.uint32)
    out = np.empty((samples, len(sets)), np.uint32)
    for i in range(samples):
        out[i] = np.minimum.reduceat(flat * a[i] + b[i], starts)
    return out.T.copy()


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One int64 for each band of each signature."""
    n, rows = len(signature), signature.shape[1] // bands
    x = signature.reshape(n, bands, rows).astype(np.uint64)
    key = (x * common.seeds(rows, 303)).sum(axis=2) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(common.BASE)
    return common.mix(key).view(np.int64)


def odd_sketches(signature: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the (sample number, sample) pairs as int64 words."""
    n, k = signature.shape
    spot = common.mix(signature.astype(np.uint64) + (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    flat = np.arange(n, dtype=np.int64)[:, None] * bits + spot.astype(np.int64)
    odd = (np.bincount(flat.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def estimate_limit(samples: int = SAMPLES, bits: int = SKETCH_BITS, least: float = LEAST_ESTIMATE) -> int:
    """The largest XOR population count whose estimate is at least `least`.

    samples * (1 - J) samples differ, each toggling two bits, so that a count
    z estimates J = 1 + bits / (4 * samples) * ln(1 - 2 z / bits).
    """
    return int(bits / 2 * (1 - np.exp(-4 * samples * (1 - least) / bits)))


_FEATURES = "id bigint, n_shingles bigint, set_hi bigint, set_lo bigint, bands array<bigint>, sketch array<bigint>"


def _features(batches):
    for batch in batches:
        data, off = common.text_bytes(batch.column(1))
        for i, j in common.slices(off, CHUNK):
            sets = common.shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
            n = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(n)
            hi, lo = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            bands, sketch = np.zeros((0, BANDS), np.int64), np.zeros((0, SKETCH_BITS // 64), np.int64)
            if len(full):
                some = [sets[x] for x in full]
                starts = np.cumsum([0] + [len(x) for x in some[:-1]])
                flat = np.concatenate(some)
                hi[full] = np.add.reduceat(common.mix(flat ^ np.uint64(0xA5A5)), starts).view(np.int64)
                lo[full] = np.bitwise_xor.reduceat(common.mix(flat + np.uint64(77)), starts).view(np.int64)
                s = signatures(some)
                bands, sketch = band_keys(s), odd_sketches(s)
            ends = lambda w: pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, w, 0)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i), pa.array(n), pa.array(hi), pa.array(lo),
                    pa.ListArray.from_arrays(ends(bands.shape[1]), pa.array(bands.ravel())),
                    pa.ListArray.from_arrays(ends(sketch.shape[1]), pa.array(sketch.ravel())),
                ],
                names=["id", "n_shingles", "set_hi", "set_lo", "bands", "sketch"],
            )


def _sets(batches):
    for batch in batches:
        data, off = common.text_bytes(batch.column(1))
        for i, j in common.slices(off, CHUNK):
            sets = common.shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
            ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "shingles"])


def _alike(x: str, y: str) -> str:
    """SQL: sizes allow resemblance 0.75 and the sketches make it plausible."""
    ones = " + ".join(f"bit_count({x}.sketch[{i}] ^ {y}.sketch[{i}])" for i in range(SKETCH_BITS // 64))
    return f"4 * least({x}.n, {y}.n) >= 3 * greatest({x}.n, {y}.n) and {ones} <= {estimate_limit()}"


def _sets_of(ids: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, shingles) of the texts with these distinct ids, written once.

    Candidates grow with the corpus, so texts meet them by a shuffle at every size.
    """
    ids = scratch.keep(ids)
    return scratch.keep(texts.join(ids.hint("merge"), "id", "left_semi").mapInArrow(_sets, "id bigint, shingles array<bigint>"))


def _confirmed(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Those pairs (a, b) for which 100 * |A n B| >= 75 * |A u B| on full sets."""
    pairs = scratch.keep(pairs)
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets_of(wanted, texts, scratch)
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("s", "t")))
    good = both.where("100 * common >= 75 * (size(s) + size(t) - common)").select("a", "b")
    good = scratch.keep(good)
    scratch.drop(pairs, sets)
    return good


def _runs(batches, keys: int):
    """Tables of whole runs of rows that agree in the leading columns, and where each run starts and ends."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in range(keys)]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cut = int(edges[-1]) if len(edges) else 0
        if cut:
            yield table.slice(0, cut), [0, *edges.tolist()]
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


_BLOCK = ("band", "xb", "yb", "minor", "id", "label")
_ALIKE = "band bigint, xb int, yb int, part int, minor boolean, id bigint, label bigint"


def _look_alike(part: int):
    """From sorted blocks, the members of each part of one that have a look-alike of another label there."""
    limit = estimate_limit()

    def run(batches):
        for table, ends in _runs(batches, 3):
            minor, label, n = (table.column(k).to_numpy(zero_copy_only=False) for k in (3, 5, 6))
            sketch = table.column(7).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
            rows, parts = [], []
            for low, high in zip(ends, ends[1:]):
                x, y = low + np.flatnonzero(minor[low:high]), low + np.flatnonzero(~minor[low:high])
                across = -(-len(y) // part)
                for i in range(0, len(x), part):
                    some = x[i : i + part]
                    for j in range(0, len(y), part):
                        other = y[j : j + part]
                        nx, ny = n[some][:, None], n[other][None, :]
                        fits = (4 * np.minimum(nx, ny) >= 3 * np.maximum(nx, ny)) & (label[some][:, None] != label[other][None, :])
                        if not fits.any():
                            continue
                        fits &= np.bitwise_count(sketch[some][:, None, :] ^ sketch[other][None, :, :]).sum(axis=2, dtype=np.int64) <= limit
                        found = np.concatenate((some[fits.any(axis=1)], other[fits.any(axis=0)]))
                        rows.append(found)
                        parts.append(np.full(len(found), i // part * across + j // part, np.int32))
            if rows:
                own = table.select(list(_BLOCK)).take(pa.array(np.concatenate(rows))).combine_chunks()
                own = own.add_column(3, "part", pa.array(np.concatenate(parts)))
                yield from own.to_batches()

    return run


def _linked(batches):
    """From sorted parts with full sets, links between minor members and others of different labels."""
    for table, ends in _runs(batches, 4):
        minor, ids, labels = (table.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6))
        lists = table.column(7).combine_chunks()
        at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        shingles, found = lists.flatten().to_numpy().view(np.uint64), []
        for low, high in zip(ends, ends[1:]):
            x, y = low + np.flatnonzero(minor[low:high]), low + np.flatnonzero(~minor[low:high])
            if not len(x) or not len(y):
                continue
            ny = at[y + 1] - at[y]
            flat = np.concatenate([shingles[at[k] : at[k + 1]] for k in y.tolist()])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(y)), ny)[order]
            for k in x.tolist():
                own = shingles[at[k] : at[k + 1]]
                first = np.searchsorted(flat, own)
                count = np.searchsorted(flat, own, side="right") - first
                spots = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                both = np.bincount(owner[spots], minlength=len(y))
                good = np.flatnonzero((100 * both >= 75 * (len(own) + ny - both)) & (labels[y] != labels[k]))
                _, one = np.unique(labels[y[good]], return_index=True)  # one link connects two components
                found += [(min(ids[k], i), max(ids[k], i)) for i in ids[y[good[one]]].tolist()]
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _across(labelled: DataFrame, sketches: DataFrame, texts: DataFrame, scratch: Scratch, block: int = 0, part: int = 0) -> DataFrame:
    """Links (a, b) between members (band, id, label) of a bucket whose labels differ."""
    block, part = block or BLOCK, part or PART
    counts = labelled.groupBy("band", "label").agg(F.count("*").alias("c"))
    per = counts.groupBy("band").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    per = per.select("band", F.col("m.label").alias("top"), F.ceil((F.col("n") - F.col("m.c")) / block).cast("int").alias("xn"), F.ceil(F.col("n") / block).cast("int").alias("yn"))
    per = scratch.keep(per)
    many = labelled.join(per, "band").withColumn("spot", F.xxhash64("id", "band"))
    x = many.where("label <> top").select("band", F.expr("cast(pmod(spot, xn) as int)").alias("xb"), F.explode(F.expr("sequence(0, yn - 1)")).alias("yb"), F.lit(True).alias("minor"), "id", "label")
    y = many.select("band", F.explode(F.expr("sequence(0, xn - 1)")).alias("xb"), F.expr("cast(pmod(spot, yn) as int)").alias("yb"), F.lit(False).alias("minor"), "id", "label")
    spread = x.unionAll(y).join(sketches, "id").select(*_BLOCK, "n", "sketch")
    blocks = spread.repartition("band", "xb", "yb").sortWithinPartitions("band", "xb", "yb")
    alike = scratch.keep(blocks.mapInArrow(_look_alike(part), _ALIKE))
    sets = _sets_of(alike.select("id").distinct(), texts, scratch)
    keys = ["band", "xb", "yb", "part"]
    parts = alike.join(sets, "id").select(*keys, "minor", "id", "label", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    out = scratch.keep(parts.mapInArrow(_linked, "a bigint, b bigint").distinct())
    scratch.drop(per, alike, sets)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents link where their shingle sets' resemblance is 0.75 or more;
    component_id is the smallest id reachable and kept marks that document.
    Null, empty and blank texts have no shingles and link with nothing. Equal
    texts always link. Rows that repeat an id are each returned; their texts
    all take part and the id shares one component. A null id links with nothing
    and is kept, with a null component. Other columns are ignored; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    features = scratch.keep(texts.mapInArrow(_features, _FEATURES))
    full = features.where("n_shingles > 0 and id is not null")
    classes = scratch.keep(full.groupBy("set_hi", "set_lo").agg(F.min("id").alias("rep")))
    # an id whose rows have several texts joins their classes
    same_id = full.groupBy("id").agg(F.min("set_hi").alias("x"), F.max("set_hi").alias("y")).where("x <> y").select("id")
    repeated = full.join(same_id, "id", "left_semi").join(classes, ["set_hi", "set_lo"])
    repeated = scratch.keep(repeated.select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct())
    reps = full.join(classes.withColumnRenamed("rep", "id"), ["id", "set_hi", "set_lo"], "left_semi")
    sketches_ = scratch.keep(reps.select("id", F.col("n_shingles").alias("n"), "sketch", "bands"))
    member = sketches_.select(F.explode("bands").alias("band"), "id")
    sketches = sketches_.drop("bands")
    leaders = scratch.keep(member.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("band", "lead"))  # a written table, so that the join on a hot band can be split
    shared = scratch.keep(member.join(leaders, "band").distinct())
    first = shared.where("lead < id").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    first = first.join(sketches.select(F.col("id").alias("a"), F.struct("n", "sketch").alias("x")), "a").join(sketches.select(F.col("id").alias("b"), F.struct("n", "sketch").alias("y")), "b")
    links = _confirmed(first.where(_alike("x", "y")).select("a", "b").distinct(), texts, scratch).unionAll(repeated)
    labels = components(links, scratch)

    labelled = scratch.keep(shared.join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("label")))
    more = _across(labelled, sketches, texts, scratch)
    if not more.isEmpty():
        labels = components(links.unionAll(more), scratch)
    scratch.drop(shared, labelled, sketches_, leaders, more)

    of_class = classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component_id"))
    alone = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    out = features.select("id", "n_shingles", "set_hi", "set_lo").join(of_class, ["set_hi", "set_lo"], "left").withColumn("component_id", F.when(F.col("id").isNull(), None).otherwise(alone))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
