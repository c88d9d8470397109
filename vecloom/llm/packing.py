"""Packing tokenized documents into sequences of bounded length.

Only a document longer than the capacity is cut, into full pieces; its first
piece takes the remainder.  A full piece fills a sequence alone, so what has to
be packed is the histogram of shorter lengths, which has fewer entries than the
capacity however many documents there are.

The plan is made on that histogram on the driver:

* the incumbent is best-fit decreasing, run on counts instead of items;
* bin completion (Korf 2003) then improves it unless it already meets a lower
  bound: around the largest remaining length it enumerates the undominated
  fillings, of any number of pieces, best fits first, takes each as often as
  counts allow or once, and prunes a branch when the waste so far exceeds what
  the incumbent leaves, or the bound of the rest reaches it.  Fillings are made
  when they are tried; ``NODE_BUDGET`` of them, dominated ones too, and the best plan found
  until then is used.

Places are given without gathering anything: a piece knows its rank among equal
lengths from per-task counts and their running totals, and a plan interval
gives the sequence and offset of that rank.

Defined results: a null text counts as empty and has the end token alone; an
empty table gives no rows; repeated rows are packed separately; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.scratch import materialize
from vecloom.llm.tokens import encoder, read_declaration

PIECES = "doc_id long, piece int, start long, length int, ids binary, ids_crc32 long, task int, nth long"
#: Fillings that bin completion may look at in all; the best plan found until then stays.
NODE_BUDGET = 20_000


# ---------------------------------------------------------------- the plan
@dataclass(frozen=True)
class Bins:
    """``count`` sequences that all hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    count: int


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by tokens, and by pieces over half the capacity."""
    tokens = sum(k * n for k, n in histogram.items())
    return max(-(-tokens // capacity), sum(n for k, n in histogram.items() if 2 * k > capacity))


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[Bins]:
    """Exactly best-fit decreasing, with equal bins kept as one group."""
    rooms: list[int] = []
    groups: dict[int, list[list]] = {}

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if n:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append([lengths, n])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                lengths, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, lengths, n = capacity, (), left
            each = min(room // length, left)
            full = min(n, left // each)
            put(room - each * length, lengths + (length,) * each, full)
            left -= full * each
            if full < n:
                rest = n - full if lengths else 0
                if left and left < each and rest:  # the last, partly filled bin of this length
                    put(room - left * length, lengths + (length,) * left, 1)
                    left, rest = 0, rest - 1
                put(room, lengths, rest)
    return [Bins(lengths, n) for found in groups.values() for lengths, n in found]


def lower_bound_of_large(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs (Martello and Toth's L2): those of the large pieces, and what the middle ones need beside them."""
    best = lower_bound(histogram, capacity)
    sizes = sorted(histogram)
    counts = [0, *accumulate(histogram[k] for k in sizes)]
    tokens = [0, *accumulate(k * histogram[k] for k in sizes)]
    half = bisect_right(sizes, capacity // 2)
    for i in range(half + 1):  # pieces of sizes[i:half] are the middle ones
        huge_from = max(half, bisect_right(sizes, capacity - (sizes[i] if i < half else capacity // 2)))
        large = counts[huge_from] - counts[half]
        room = large * capacity - (tokens[huge_from] - tokens[half])
        best = max(best, counts[-1] - counts[half] + max(0, -(-(tokens[half] - tokens[i] - room) // capacity)))
    return best


def _sums(pieces: Iterable[int], limit: int) -> int:
    """Bit s is set if some of the pieces have the sum s, up to ``limit``."""
    bits, mask = 1, (1 << (limit + 1)) - 1
    for k in pieces:
        bits |= bits << k & mask
    return bits


def dominated(filling: tuple[int, ...], counts: Counter, room: int) -> bool:
    """Whether a piece left out could take the place of some pieces of ``filling`` at least as well.

    That is so if the piece fits in the room with them gone and is as large as
    all of them together; then any plan with ``filling`` can be changed, with no
    more sequences, into one that has the piece there (Martello and Toth; Korf).
    """
    slack, used = room - sum(filling), Counter(filling)
    several = _sums(filling, room)
    for k in used:
        if used[k] == 1 and not _sums((x for x in filling if x != k), k) >> k & 1:
            several &= ~(1 << k)  # one piece changed for an equal one is no gain
    for k in used:
        if used[k] > 1:  # as above, for lengths that are there more than once
            if not _sums((x for x in filling if x < k), k) >> k & 1:
                several &= ~(1 << k)
    for x in counts:
        if x <= room and counts[x] > used[x]:
            low = max(0, x - slack)
            if several >> low & ((1 << (x - low + 1)) - 1):
                return True
    return False


def fillings(counts: Counter, capacity: int, first: int) -> Iterator[tuple[int, ...]]:
    """Every undominated filling around one piece of length ``first``, best fits first."""
    return (f for f in enumerated(counts, capacity, first) if f)


def enumerated(counts: Counter, capacity: int, first: int) -> Iterator[tuple[int, ...] | None]:
    """As ``fillings``, made when asked for, with None in place of each dominated one.

    Fillings are enumerated by the room they leave, from none on.  What the
    lengths from some place on can sum up to is known, so no branch is entered
    that doesn't end in a filling.
    """
    room = capacity - first
    free = counts.copy()
    free[first] -= 1
    free = +free
    sizes = sorted((k for k in free if k <= room), reverse=True)
    reach = [1]  # sums that the lengths from the last one back to i can have
    for k in reversed(sizes):
        bits, left, step = reach[-1], min(free[k], room // k), 1
        while left:
            take = min(step, left)
            bits |= bits << k * take & ((1 << (room + 1)) - 1)
            left, step = left - take, step * 2
        reach.append(bits)
    reach.reverse()

    def exact(i: int, total: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not total:
            yield chosen
            return
        if i == len(sizes) or not reach[i] >> total & 1:
            return
        k = sizes[i]
        for n in range(min(free[k], total // k), -1, -1):
            yield from exact(i + 1, total - n * k, chosen + (k,) * n)

    for total in range(room, -1, -1):
        if reach[0] >> total & 1:
            for chosen in exact(0, total, ()):
                yield None if dominated(chosen, free, room) else (first, *chosen)


def bin_completion(histogram: dict[int, int], capacity: int, incumbent: list[Bins], budget: int = NODE_BUDGET) -> list[Bins]:
    """The best plan that branch and bound finds within its budget; never worse than ``incumbent``.

    A node fills a sequence around the largest piece left.  A filling is taken as
    often as the counts allow, and then, as another branch, once.
    """
    best, best_n = incumbent, sum(b.count for b in incumbent)
    tokens = sum(k * n for k, n in histogram.items())
    bound = lower_bound_of_large(histogram, capacity)

    def branches(counts: Counter) -> Iterator[tuple[tuple[int, ...] | None, int]]:
        for filling in enumerated(counts, capacity, max(counts)):
            if filling is None:
                yield None, 0
                continue
            most = min(counts[k] // n for k, n in Counter(filling).items())
            yield filling, most
            if most > 1:
                yield filling, 1

    # a level: the counts, the branches not tried yet, and the plan, sequences and waste so far
    levels = [(Counter(histogram), branches(Counter(histogram)), None, 0, 0)] if histogram else []
    tried = 0
    while levels and tried < budget and best_n > bound:
        counts, options, plan, used, waste = levels[-1]
        option = next(options, None)
        if option is None:
            levels.pop()
            continue
        tried += 1
        filling, times = option
        if filling is None:
            continue
        left = counts.copy()
        for k, n in Counter(filling).items():
            left[k] -= n * times
        left, plan, used, waste = +left, (plan, Bins(filling, times)), used + times, waste + times * (capacity - sum(filling))
        if not left:
            if used < best_n:
                best_n, best = used, []
                while plan:
                    plan, last = plan
                    best.append(last)
            continue
        # a better plan has at most best_n - 1 sequences, which leave only this much room unused
        if waste > (best_n - 1) * capacity - tokens or used + lower_bound_of_large(left, capacity) >= best_n:
            continue
        levels.append((left, branches(left), plan, used, waste))
    return best


def make_plan(histogram: dict[int, int], capacity: int) -> list[Bins]:
    """Sequences for every piece of the histogram (lengths from 1 to ``capacity``)."""
    whole = {capacity: histogram[capacity]} if histogram.get(capacity) else {}
    rest = {k: n for k, n in histogram.items() if n and k != capacity}
    plan = best_fit_decreasing(rest, capacity)
    if sum(b.count for b in plan) > lower_bound_of_large(rest, capacity):
        plan = bin_completion(rest, capacity, plan)
    return [Bins((k,), n) for k, n in whole.items()] + plan


def intervals(plan: list[Bins]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks, the sequence of the first rank, and the offset, of each run of ranks."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: Counter = Counter()
    base = 0
    for bins in plan:
        offset = 0
        for length in bins.lengths:
            runs.setdefault(length, []).append((ranks[length], base, offset))
            ranks[length] += bins.count
            offset += length
        base += bins.count
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for k, r in runs.items()}


# ------------------------------------------------------------- the operator
def pieces(docs: DataFrame, declaration: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """Pieces of every document: ids (little-endian unsigned 32 bit), their crc32, and the rank within (task, length)."""
    shipped = docs.sparkSession.sparkContext.broadcast(declaration)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shipped.value)
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, size = [], 0
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode_all(batch.column("text"), end)):
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    raw = ids[a:b].tobytes()
                    rows.append((doc_id, i, a, b - a, raw, zlib.crc32(raw), task, seen[b - a]))
                    seen[b - a] += 1
                    size += len(raw)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
    names = [p.split()[0] for p in PIECES.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """Every piece with its ids, ``sequence_id`` and ``offset``; offsets in a sequence have no gap from 0 on."""
    stored = materialize(pieces(docs, read_declaration(tokenizer_path), capacity, end), "pieces")
    counts = materialize(stored.groupBy("task", "length").agg((F.max("nth") + 1).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = intervals(make_plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = stored.join(offsets, ["task", "length"])
    runs = docs.sparkSession.sparkContext.broadcast(plan)  # a few runs per length, and at most `capacity` lengths

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        n, rank = lengths.to_numpy(), ranks.to_numpy()
        for length in np.unique(n):
            at = np.flatnonzero(n == length)
            first, base, place_in = runs.value[int(length)]
            i = np.searchsorted(first, rank[at], side="right") - 1
            sequence[at], offset[at] = base[i] + rank[at] - first[i], place_in[i]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("at", place("length", F.col("ahead") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids and how many tokens each document holds, in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))
