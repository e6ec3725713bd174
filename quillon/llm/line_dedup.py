"""Line dedup: winnowed fingerprints find repeated runs; later copies go.

A copied passage need not keep its lines: it may begin or end inside one, or
be wrapped anew. Hashes of whole lines miss such copies, so the units that are
hashed are words, and a passage is a run of `min_words` of them. Every run
selects the least hash of GRAM words within it as its anchor, the winnowing
guarantee: equal runs have equal anchors. Anchors that occur once leave the
search. Positions meet by their anchors: the runs around one anchor are
compared as one stretch, and where stretches of one anchor differ, run by run.
Each match reaches as far both ways as its runs agree, and the later copies
are deleted, with the line breaks that held only them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import common
from quillon.llm.common import Scratch

MIN_WORDS = 50
#: Words in an anchor of a passage; shorter passages take all their words.
GRAM = 16
#: Bytes of text that a task hashes at once.
CHUNK = 1 << 18


def _rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` of the words, rows aside."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * common.powers(len(words)), out=sums[1:])
    n = max(len(words) - width + 1, 0)
    return common.mix((sums[width : width + n] - sums[:n]) * common.powers(len(words), "down")[:n])


def _anchors(batch, column: int, min_words: int):
    """For slices of a batch: rows, bytes, offsets, words, each row's first word, grams, and per row the anchor of each run."""
    gram = min(GRAM, min_words)
    data, off = common.text_bytes(batch.column(column))
    for i, j in common.slices(off, CHUNK):
        own, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        words, first = common.word_hashes(own, at, fold=False)
        grams, anchors = _rolled(words, gram), []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = b - a - min_words + 1
            if n < 1:
                anchors.append(None)
                continue
            view = np.lib.stride_tricks.sliding_window_view(grams[a : b - gram + 1], min_words - gram + 1)
            anchors.append(view.argmin(axis=1) + np.arange(n))
        yield i, j, own, at, words, first, grams, anchors


def _stretches(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last run of each stretch of runs that have one anchor."""
    edge = np.flatnonzero(anchors[1:] != anchors[:-1])
    return np.concatenate(([0], edge + 1)), np.append(edge, len(anchors) - 1)


def _anchor_scan(min_words: int):
    gram = min(GRAM, min_words)

    def run(batches):
        for batch in batches:
            for i, j, data, at, words, first, grams, anchors in _anchors(batch, 2, min_words):
                starts, ends = common.word_spans(data, at)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                # scrambled grams, not words, so that no regular pattern of words cancels out
                sums = np.concatenate((grams[:0], [np.uint64(0)], np.cumsum(grams * common.powers(len(grams)))))
                down = common.powers(len(words), "down")
                rows, h, k, s, e = [first[:0]], [grams[:0]], [grams[:0]], [first[:0]], [first[:0]]
                for row, own in enumerate(anchors):
                    if own is None:
                        continue
                    low, high = _stretches(own)
                    rows.append(np.full(len(low), i + row))
                    h.append(grams[first[row] + own[low]])
                    a, b = first[row] + low, first[row] + high + min_words
                    k.append(common.mix((sums[b - gram + 1] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
                    s.append(points[starts[a]] - points[at[row]])
                    e.append(points[ends[b - 1]] - points[at[row]])
                rows = pa.array(np.concatenate(rows))
                h, k = (pa.array(np.concatenate(x).view(np.int64)) for x in (h, k))
                s, e = (pa.array(np.concatenate(x).astype(np.int32)) for x in (s, e))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), h, k, s, e], names=["id", "th", "h", "k", "s", "e"])

    return run


def _run_scan(min_words: int):
    gram = min(GRAM, min_words)

    def run(batches):
        for batch in batches:
            for i, j, data, at, words, first, grams, anchors in _anchors(batch, 2, min_words):
                keys = _rolled(grams, min_words - gram + 1)
                starts, ends = common.word_spans(data, at)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                rows, k, s, e = [first[:0]], [keys[:0]], [first[:0]], [first[:0]]
                for row, (own, wanted) in enumerate(zip(anchors, batch.column(3).slice(i, j - i).to_pylist())):
                    if own is None:
                        continue
                    low, high = _stretches(own)
                    asked = np.isin(points[starts[first[row] + low]] - points[at[row]], wanted)
                    runs = np.flatnonzero(np.repeat(asked, high - low + 1)) + first[row]
                    rows.append(np.full(len(runs), i + row))
                    k.append(keys[runs])
                    s.append(points[starts[runs]] - points[at[row]])
                    e.append(points[ends[runs + min_words - 1]] - points[at[row]])
                rows = pa.array(np.concatenate(rows))
                s, e = (pa.array(np.concatenate(x).astype(np.int32)) for x in (s, e))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(k).view(np.int64)), s, e], names=["id", "th", "k", "s", "e"])

    return run


def _merge(batches):
    for batch in batches:
        ids, ths, spans = (c.to_pylist() for c in batch.columns)
        cuts = []
        for own in spans:
            out: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in own):
                if out and s <= out[-1][1]:
                    out[-1][1] = max(e, out[-1][1])
                else:
                    out.append([s, e])
            cuts.append([{"s": s, "e": e} for s, e in out])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["id", "th", "cuts"])


def erase(text: str, cuts: list[tuple[int, int]]) -> str:
    """text without the cuts, which are sorted and begin and end with a word.

    A cut that begins a line takes the white space behind it, up to the next
    line if it ends its own; any other cut takes the white space before it.
    """
    space, joined = "".join(map(chr, common.WORD_SEPARATORS)), []
    for s, e in cuts:
        if joined and not text[joined[-1][1] : s].strip(space):
            joined[-1][1] = e
        else:
            joined.append([s, e])
    out, at = [], 0
    for s, e in joined:
        left, right = len(text[at:s].rstrip(space)) + at, len(text) - len(text[e:].lstrip(space))
        if right < len(text) and (left == 0 or "\n" in text[left:s]):
            line = text.rfind("\n", e, right) + 1
            s, e = (max(left, text.rfind("\n", left, s) + 1), line) if line else (s, right)
        else:
            s = left
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    whole = "".join(out)
    return whole if whole.strip(space) else ""


def drop_repeated_passages(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = MIN_WORDS, count_col: str | None = None, words_col: str | None = None) -> DataFrame:
    """docs without any run of min_words words that stands at an earlier place too.

    Words compare as whole strings; the white space between them does not
    count, so lines may break anywhere. All columns stay, with the text
    replaced; count_col and words_col, if given, are added and count the lines
    and the words that went. Documents are ordered by id, those that repeat an
    id by a hash of the text; rows equal in both are one document and keep
    equal texts. Of copies within a document the first stays. A null id or
    text stays as it is and matches nothing. A text whose words all go becomes
    empty. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    id_, text = F.col(f"row.`{id_col}`").cast("long"), F.col(f"row.`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", id_.alias("id"), F.xxhash64(text).alias("th"))
    scanned = rows.where(F.col("id").isNotNull() & text.isNotNull()).select("id", "th", text.alias("text"))
    place = F.struct("id", "th", "s")

    def repeated(spans, *more):
        """The first place of each key that stands twice, and the spans at later ones."""
        first = spans.groupBy("k").agg(F.min(place).alias("f"), F.count("*").alias("c"), *more)
        first = scratch.keep(first.select("k", F.col("f.id").alias("fid"), F.col("f.th").alias("fth"), F.col("f.s").alias("fs"), "c", *[F.col("h")] * len(more)))  # a written table, so that the join on a hot key can be split
        twice = first.where("c > 1").select("k", "fid", "fth", "fs")
        return first, scratch.keep(spans.join(twice, "k").where("struct(id, th, s) > struct(fid, fth, fs)").select("id", "th", "s", "e"))

    anchors = scratch.keep(scanned.mapInArrow(_anchor_scan(min_words), "id bigint, th bigint, h bigint, k bigint, s int, e int"))
    shared = scratch.keep(anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))  # written, as are the other sides of joins on hot keys
    spans = scratch.keep(anchors.join(shared, "h", "left_semi"))
    scratch.drop(anchors, shared)
    # runs of one anchor that all stand earlier go as one; what is left to compare run by run are anchors within unlike runs
    first, whole = repeated(spans, F.first("h").alias("h"))
    unlike = scratch.keep(first.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    wanted = first.join(unlike, "h", "left_semi").groupBy(F.col("fid").alias("id"), F.col("fth").alias("th")).agg(F.collect_set("fs").alias("wanted"))
    wanted = scratch.keep(wanted)
    scratch.drop(spans, first, unlike)
    # they grow with the corpus, so texts meet them by a shuffle at every size
    behind = scanned.join(wanted.hint("merge"), ["id", "th"]).select("id", "th", "text", "wanted")
    runs = scratch.keep(behind.mapInArrow(_run_scan(min_words), "id bigint, th bigint, k bigint, s int, e int"))
    first, single = repeated(runs)
    cut = whole.unionAll(single).groupBy("id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    cut = scratch.keep(cut.mapInArrow(_merge, "id bigint, th bigint, cuts array<struct<s int, e int>>"))
    scratch.drop(wanted, runs, first, whole, single)

    @F.pandas_udf("string")
    def erased(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else erase(t, [(x["s"], x["e"]) for x in c]) for t, c in zip(texts, cuts)], dtype=object)

    joined = rows.join(cut.hint("merge"), ["id", "th"], "left")
    joined = joined.withColumn("new", erased(F.when(F.col("cuts").isNotNull(), text), F.col("cuts")))
    out = [(F.coalesce("new", text) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    if count_col:
        lines = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, "\n", -1)))
        out.append(F.when(F.col("cuts").isNull(), 0).otherwise(lines(text) - lines(F.col("new"))).alias(count_col))
    if words_col:
        words = lambda c: F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+"))
        out.append(F.when(F.col("cuts").isNull(), 0).otherwise(words(text) - words(F.col("new"))).alias(words_col))
    return joined.select(*out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_passages(docs, count_col="lines_deleted", words_col="words_deleted")
