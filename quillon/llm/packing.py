"""Best-fit packing of tokenized documents by bin completion.

Pieces of one length are interchangeable, so the problem that is solved is the
histogram of lengths: at most `capacity` numbers, however large the corpus.
The driver fills sequences around the largest length left, each as often as
the counts allow; tasks then look up their pieces' places by length and rank.
"""

from __future__ import annotations

import bisect
import itertools
import logging
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.llm import common
from quillon.llm.common import Scratch
from quillon.llm.tokens import word_bpe

CAPACITY, VOCABULARY = 2048, "word_bpe_49k.json"
#: Steps that the greedy completion looks for one sequence's filling.
FILLINGS = 600
#: Limits of the branch and bound: nodes, and steps of enumerating fillings in
#: all of them. A packing that they leave unproven is reported as such.
NODES, STEPS = 20_000, 3_000_000
#: The repair of an incumbent: tries, pieces taken anew in one, and its limits.
REPAIRS, HANDFUL, REPAIR_NODES, REPAIR_STEPS = 200, 60, 200, 30_000
#: Fillings that are put in order of waste at a time.
SORTED = 64

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how often, ((length, how many), ...)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs.

    For every length k up to half the capacity: pieces over half need one
    each, and those of k and more must fit beside the ones that leave room.
    """
    if not counts:
        return 0
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    upto, tokens = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * sizes)))
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    low = np.arange(half + 1)  # the first piece that counts; half: none
    least = np.append(sizes[:half], capacity // 2 + 1)
    least[0] = 0
    beside = np.maximum(np.searchsorted(sizes, capacity - least, side="right"), half)
    room = (upto[beside] - upto[half]) * capacity - (tokens[beside] - tokens[half])
    more = -(-(tokens[half] - tokens[low] - room) // capacity)
    return int(upto[-1] - upto[half] + np.maximum(more, 0).max())


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram; bins of one shape are kept as one."""
    open_bins: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []  # sorted

    def put(room, shape, n):
        at = open_bins.setdefault(room, {})
        if not at:
            bisect.insort(rooms, room)
        at[shape] = at.get(shape, 0) + n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size
                if left >= per:
                    put(capacity - per * size, ((size, per),), left // per)
                    left %= per
                else:
                    put(capacity - left * size, ((size, left),), 1)
                    left = 0
                continue
            room = rooms[i]
            shape, have = open_bins[room].popitem()
            per = room // size
            if left >= per:
                n = min(have, left // per)
            else:
                n, per = 1, left
            if have > n:
                open_bins[room][shape] = have - n
            if not open_bins[room]:
                rooms.remove(room)
                del open_bins[room]
            put(room - per * size, (*shape, (size, per)), n)
            left -= n * per
    return [(n, shape) for bins in open_bins.values() for shape, n in bins.items()]


def fillings(counts: dict[int, int], sizes: list[int], room: int, slack: int | None = None, spent: list[int] | None = None, steps: int | None = None):
    """Undominated multisets of sizes for a room, one by one, as (waste, ((size, n), ...)).

    sizes are those with a count, ascending. A filling is dominated if a spare
    piece fits into its waste or a member can be swapped for a larger spare
    one; a piece that fills what is left is taken alone, as any others there
    could be swapped for it. All others come, larger members first, unless
    slack is the most waste that is asked for. spent counts the steps; the
    enumeration ends early where they reach `steps`.
    """
    spent = [0] if spent is None else spent
    below_sum = [0]
    for s in sizes:
        below_sum.append(below_sum[-1] + s * counts[s])
    stack = [(room, len(sizes), ())]
    while stack:
        spent[0] += 1
        if steps is not None and spent[0] >= steps:
            return
        rest, below, chosen = stack.pop()
        i = min(below, bisect.bisect_right(sizes, rest))
        if slack is not None and rest - below_sum[i] > slack:
            continue
        if i == 0:
            used = dict(chosen)
            is_spare = lambda s: counts[s] > used.get(s, 0)
            if rest and any(map(is_spare, sizes[: bisect.bisect_right(sizes, rest)])):
                continue
            if rest and any(is_spare(x) for s in used for x in sizes[bisect.bisect_right(sizes, s) : bisect.bisect_right(sizes, s + rest)]):
                continue
            yield rest, chosen
            continue
        fits = bisect.bisect_left(sizes, rest)
        if fits < i and sizes[fits] == rest:
            yield 0, (*chosen, (rest, 1))
            continue
        size = sizes[i - 1]
        stack.append((rest, i - 1, chosen))
        for k in range(1, min(counts[size], rest // size) + 1):
            stack.append((rest - k * size, i - 1, (*chosen, (size, k))))


def _greedy(counts: dict[int, int], sizes: list[int], room: int) -> tuple:
    chosen = []
    for size in reversed(sizes[: bisect.bisect_right(sizes, room)]):
        if n := min(counts[size], room // size):
            chosen.append((size, n))
            room -= n * size
    return tuple(chosen)


def complete(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Bin completion over a histogram: the least wasteful filling found for
    the largest piece left, as often as the counts allow."""
    counts = {k: v for k, v in counts.items() if v}
    sizes, out = sorted(counts), []
    while sizes:
        top = sizes[-1]
        counts[top] -= 1
        if not counts[top]:
            sizes.pop()
        least, best = capacity, None
        for lost, filling in fillings(counts, sizes, capacity - top, None, [0], FILLINGS):
            if lost < least:
                least, best = lost, filling
            if not lost:
                break
        shape = dict(_greedy(counts, sizes, capacity - top) if best is None else best)
        shape[top] = shape.get(top, 0) + 1
        counts[top] = counts.get(top, 0) + 1
        if not sizes or sizes[-1] != top:
            sizes.append(top)
        times = min(counts[s] // n for s, n in shape.items())
        for s, n in shape.items():
            counts[s] -= n * times
            if not counts[s]:
                sizes.pop(bisect.bisect_left(sizes, s))
        out.append((times, tuple(sorted(shape.items(), reverse=True))))
    return out


def used(patterns: list[Pattern]) -> int:
    """Sequences of a packing."""
    return sum(n for n, _ in patterns)


def search(counts: dict[int, int], capacity: int, incumbent: list[Pattern], nodes: int = NODES, steps: int = STEPS) -> tuple[list[Pattern], bool]:
    """Branch and bound over fillings of the largest piece left: the best packing and whether it is proven least.

    A node is a histogram of the pieces left. It branches over all undominated
    fillings, those of little waste first, each laid as often as the counts
    allow and then half as often, down to once. A branch is cut where its
    waste so far, or the lower bound of what is left, leaves no packing
    smaller than the incumbent, and where the same pieces were left before
    with no more sequences used. Only the limits end it unproven.
    """
    total, best, least = sum(k * v for k, v in counts.items()), incumbent, used(incumbent)
    bound, spent, seen = lower_bound(counts, capacity), [0], {}
    rng = random.Random(1)
    mark = {size: rng.getrandbits(128) for size in sorted(counts)}

    def branches(left: dict[int, int], waste: int):
        top = max(left)
        rest = {k: v - (k == top) for k, v in left.items() if v > (k == top)}
        options = fillings(rest, sorted(rest), capacity - top, (least - 1) * capacity - total - waste, spent, steps)
        while some := sorted(itertools.islice(options, SORTED), key=lambda f: f[0]):
            for lost, filling in some:
                shape = dict(filling)
                shape[top] = shape.get(top, 0) + 1
                times = min(left[s] // n for s, n in shape.items())
                while times:
                    yield lost, tuple(sorted(shape.items(), reverse=True)), times
                    times //= 2

    visited = 0
    stack = [(dict(counts), 0, 0, 0, None, branches(counts, 0))] if counts else []
    while stack and least > bound:
        if visited >= nodes or spent[0] >= steps:
            return best, False
        left, bins, waste, key, trail, options = stack[-1]
        option = next(options, None)
        if option is None:
            stack.pop()
            continue
        lost, shape, times = option
        visited += 1
        more, count = waste + lost * times, bins + times
        if more > (least - 1) * capacity - total:
            continue
        rest = dict(left)
        for s, n in shape:
            rest[s] -= n * times
            key += mark[s] * n * times
            if not rest[s]:
                del rest[s]
        if not rest:
            if count < least:
                least, best, at = count, [(times, shape)], trail
                while at:
                    best.append(at[0])
                    at = at[1]
            continue
        if count + lower_bound(rest, capacity) >= least or seen.get(key, least) <= count:
            continue
        seen[key] = count
        stack.append((rest, count, more, key, ((times, shape), trail), branches(rest, more)))
    return best, spent[0] < steps or least <= bound


def _waste(shape: tuple[tuple[int, int], ...], capacity: int) -> int:
    return capacity - sum(size * n for size, n in shape)


def repair(patterns: list[Pattern], counts: dict[int, int], capacity: int, tries: int = REPAIRS) -> list[Pattern]:
    """A better incumbent: packs handfuls of wasteful sequences anew, each as often as its patterns allow.

    A handful has at most HANDFUL pieces, drawn by waste with a fixed seed; a
    short search replaces it where it needs fewer sequences.
    """
    have: dict[tuple, int] = {}
    for n, shape in patterns:
        have[shape] = have.get(shape, 0) + n
    now, bound, rng = used(patterns), lower_bound(counts, capacity), random.Random(0)
    for _ in range(tries):
        if now <= bound:
            break
        shapes = list(have)
        weights = [have[x] * _waste(x, capacity) for x in shapes]
        if not any(weights):
            break
        taken: dict[tuple, int] = {}
        pieces: dict[int, int] = {}
        for shape in rng.choices(shapes, weights, k=HANDFUL):
            if taken.get(shape, 0) < have[shape] and sum(pieces.values()) + sum(n for _, n in shape) <= HANDFUL:
                taken[shape] = taken.get(shape, 0) + 1
                for size, n in shape:
                    pieces[size] = pieces.get(size, 0) + n
        before = sum(taken.values())
        if lower_bound(pieces, capacity) >= before:
            continue
        anew = min(best_fit(pieces, capacity), complete(pieces, capacity), key=used)
        anew, _ = search(pieces, capacity, anew, REPAIR_NODES, REPAIR_STEPS)
        if used(anew) >= before:
            continue
        times = min(have[x] // n for x, n in taken.items())
        for x, n in taken.items():
            have[x] -= n * times
            if not have[x]:
                del have[x]
        for n, x in anew:
            have[x] = have.get(x, 0) + n * times
        now -= (before - used(anew)) * times
    return [(n, x) for x, n in have.items()]


def packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], int, bool]:
    """Patterns that together hold each length exactly as often as counted, the
    lower bound of their number, and whether they are proven least.

    Best fit and greedy bin completion give the first incumbent. While it is
    above the bound, handfuls of it are packed anew and then the branch and
    bound runs over the whole histogram, at every size of the input alike.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    full = counts.pop(capacity, 0)
    bound = lower_bound(counts, capacity)
    best, proven = min(best_fit(counts, capacity), complete(counts, capacity), key=used), True
    if used(best) > bound:
        best, proven = search(counts, capacity, repair(best, counts, capacity))
    return [*best, *[(full, ((capacity, 1),))] * bool(full)], bound + full, proven


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """The patterns of packing()."""
    return packing(counts, capacity)[0]


def layout(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, how many in a sequence, first sequence, first offset)."""
    rank: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for times, shape in patterns:
        offset = 0
        merged: dict[int, int] = {}
        for size, n in shape:
            merged[size] = merged.get(size, 0) + n
        for size, n in merged.items():
            rows.setdefault(size, []).append((rank.get(size, 0), n, sequence, offset))
            rank[size] = rank.get(size, 0) + n * times
            offset += size * n
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


_PIECES = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def _tokenize(vocabulary: str, capacity: int):
    def run(batches):
        bpe, ranks, part = word_bpe(vocabulary), np.zeros(capacity + 1, np.int64).tolist(), TaskContext.get().partitionId()
        end = b"\0\0\0\0"
        for batch in batches:
            data, off = common.text_bytes(batch.column(1))
            for i, j in common.slices(off, 1 << 20):
                ids, rows = batch.column(0).slice(i, j - i).to_pylist(), []
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                for key, coded in zip(ids, bpe.encode_batch(texts)):
                    coded += end
                    n = len(coded) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - start)
                        rows.append((key, piece, start, size, zlib.crc32(coded[4 * start : 4 * (start + size)]), part, ranks[size]))
                        ranks[size] += 1
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def _place(places: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                own, table = np.flatnonzero(length == size), places[size]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + nth // row[:, 1]
                offset[own] = row[:, 3] + nth % row[:, 1] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, id_col="doc_id", text_col="text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a closing id 0; null and empty texts are that 0
    alone. Longer ones are cut into pieces of `capacity`, the last one shorter.
    A piece's place needs its rank among pieces of its length: its rank in its
    task plus the counts of the tasks before. Rows that repeat an id, and null
    ids, are packed each on its own; other columns are ignored; an empty table
    gives no rows. `vocabulary` names or locates a word-end BPE file.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.keep(texts.mapInArrow(_tokenize(vocabulary, capacity), _PIECES))
    by_task = scratch.keep(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns, bound, proven = packing(histogram, capacity)
    logging.getLogger(__name__).info("%d sequences, at least %d needed, proven least: %s", used(patterns), bound, proven)
    places = layout(patterns)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))
    placed = ranked.mapInArrow(_place(places), "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.withColumnRenamed("id", id_col)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents"))
