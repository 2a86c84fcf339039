"""Best-fit packing of token sequences by bin completion with branch and bound, over counts of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small_batches, table, width
from .tokens import encoder, path_of

#: A filling: (length, how many) of one bin, largest first; a packing: how many bins have which filling.
Filling = tuple[tuple[int, int], ...]
Packing = list[tuple[int, Filling]]


def lower_bound(counts: dict[int, int], room: int) -> int:
    """Bins that no packing can do without: by volume, and for each threshold by the large items that cannot meet."""
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[i] for i in x.tolist()], np.int64)
    sums = lambda v: np.concatenate([[0], np.cumsum(v)])
    number, volume = sums(n), sums(n * x)
    half = int(np.searchsorted(x, room // 2, "right"))  # from here on no two share a bin
    best = max(-(-int(volume[-1]) // room), int(number[-1] - number[half]))
    small = x[:half]
    if len(small):
        alone = np.searchsorted(x, room - small, "right")  # from here on nothing that large as `small` fits in
        free = room * (number[alone] - number[half]) - (volume[alone] - volume[half])
        rest = volume[half] - volume[:half]
        best = max(best, int((number[-1] - number[half] + np.maximum(0, -((free - rest) // room))).max()))
    return best


def best_fit(counts: dict[int, int], room: int) -> Packing:
    """Best-fit decreasing; bins of equal content are handled together."""
    open_: dict[int, list[tuple[int, Filling]]] = {}
    levels: list[int] = []

    def put(free: int, n: int, filling: Filling) -> None:
        if n:
            if free not in open_:
                insort(levels, free)
                open_[free] = []
            open_[free].append((n, filling))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(levels, length)
            if at < len(levels):
                free = levels[at]
                n, filling = open_[free].pop()
                if not open_[free]:
                    del open_[free], levels[at]
            else:
                free, n, filling = room, left, ()
            each = free // length
            full = min(n, left // each)
            put(free - each * length, full, (*filling, (length, each)))
            left -= full * each
            if left and full < n:
                put(free - left * length, 1, (*filling, (length, left)))
                full, left = full + 1, 0
            if filling:
                put(free, n - full, filling)
    return [(n, filling) for free in levels for n, filling in open_[free]]


def _fits_into(small: list[int], large: list[int]) -> bool:
    """Whether the items `small` can be put into bins of the sizes `large`: then the filling `large` dominates."""
    if not small:
        return True
    head, rest, tried = small[0], small[1:], set()
    for i, x in enumerate(large):
        if x >= head and x not in tried:
            tried.add(x)
            if _fits_into(rest, large[:i] + [x - head] + large[i + 1 :]):
                return True
    return False


def fillings(counts: dict[int, int], lengths: list[int], free: int, waste: int, steps: int = 400, keep: int = 8, items: int = 6) -> list[tuple[int, Filling]]:
    """Undominated fillings of `free` tokens that leave at most `waste`, least waste first. lengths: rising, those still there.

    Only the search effort is bounded (steps, keep, items); best-fit solutions stand in beyond it.
    """
    found: list[tuple[int, list[int]]] = []
    left = steps

    def extend(own: list[int], free: int, top: int) -> None:
        nonlocal left
        at = bisect_right(lengths, free, 0, top) - 1
        while at >= 0 and counts[lengths[at]] <= own.count(lengths[at]):
            at -= 1
        if at < 0:
            if free <= waste:
                found.append((free, own))
            return
        if len(own) >= items:
            while free and at >= 0:  # the rest by best fit
                x = lengths[at]
                n = min(counts[x] - own.count(x), free // x)
                own, free = own + [x] * n, free - n * x
                at = bisect_right(lengths, free, 0, at) - 1
            if free <= waste:
                found.append((free, own))
            return
        while at >= 0 and left > 0:
            x = lengths[at]
            left -= 1
            if counts[x] > own.count(x):
                extend([*own, x], free - x, at + 1)
            if found and min(f for f, _ in found) == 0 and len(found) >= keep:
                return
            at -= 1

    extend([], free, len(lengths))
    kept: list[tuple[int, list[int]]] = []
    for spare, own in sorted(found, key=lambda x: (x[0], len(x[1]), [-y for y in x[1]])):
        if len(kept) < keep and not any(_fits_into(own, other) for _, other in kept if len(other) <= len(own) <= items):
            kept.append((spare, own))
    return [(spare, tuple((x, own.count(x)) for x in dict.fromkeys(own))) for spare, own in kept]


#: Bins taken on the way to a node: how many of which filling, and the steps before.
Steps = tuple | None


def _taken(steps: Steps) -> Packing:
    out = []
    while steps:
        out.append(steps[:2])
        steps = steps[2]
    return out[::-1]


@dataclass(frozen=True)
class _Left:
    """Counts of lengths in a few bytes each."""

    lengths: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, int]) -> _Left:
        return cls(np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.int64, len(counts)))

    def after(self, whole: dict[int, int], times: int) -> dict[int, int]:
        """The counts that `times` bins of this content leave."""
        rest = dict(zip(self.lengths.tolist(), self.counts.tolist()))
        for x, n in whole.items():
            rest[x] -= times * n
            if not rest[x]:
                del rest[x]
        return rest


def pack_counts(counts: dict[int, int], room: int, nodes: int = 20_000) -> Packing:
    """Packs counts[length] items of each length into few bins of `room`.

    Best-fit decreasing gives the first incumbent. While it is above the lower bound,
    bins are completed around the largest length left: its undominated fillings are
    tried least waste first, each as often as the counts allow, branches whose waste
    cannot beat the incumbent are cut, and what every node leaves is completed by best fit,
    which may become the incumbent. nodes bounds the search, not the items.
    """
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit(counts, room)
    bins = sum(n for n, _ in best)
    least, total = lower_bound(counts, room), sum(x * n for x, n in counts.items())
    visited = 0
    # A node waiting on the stack is what its parent had left, shared with its siblings, and the step from there; steps are linked
    # to those before. Each step uses up a length, so the parents held are at most as many as there are lengths.
    stack: list[tuple[_Left, dict[int, int], int, Steps, int]] = [(_Left.of(counts), {}, 0, None, 0)]
    while stack and bins > least and visited < nodes:
        left, step, times, own, used = stack.pop()
        rest = left.after(step, times)
        visited += 1
        if used + lower_bound(rest, room) >= bins:
            continue
        tail = best_fit(rest, room)
        if used + sum(n for n, _ in tail) < bins:
            best, bins = _taken(own) + tail, used + sum(n for n, _ in tail)
        spare = (bins - 1) * room - total  # waste that a better packing may have
        wasted = used * room - (total - sum(x * n for x, n in rest.items()))
        if wasted > spare or used + lower_bound(rest, room) >= bins:
            continue
        large = max(rest)
        lengths = sorted(rest)
        without = {**rest, large: rest[large] - 1}
        held = _Left.of(rest)
        for _, filling in reversed(fillings(without, lengths, room - large, spare - wasted)):
            whole: dict[int, int] = {large: 1}
            for x, n in filling:
                whole[x] = whole.get(x, 0) + n
            times = min(rest[x] // n for x, n in whole.items())
            done = (times, tuple(whole.items()), own)
            if any(n > times * whole.get(x, 0) for x, n in rest.items()):
                stack.append((held, whole, times, done, used + times))
            elif used + times < bins:
                best, bins = _taken(done), used + times
    return best


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, room: int) -> DataFrame:
    """Token sequences of docs(doc_id, text): ids and the end id, cut into pieces of at most room tokens."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer, spaced)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), work.texts(batch.column(1))):
                data = memoryview(np.concatenate([ids.astype("<u4"), end])).cast("B")
                n = len(data) // 4
                rows += [(doc_id, i, a, min(room, n - a), zlib.crc32(data[4 * a : 4 * (a + room)])) for i, a in enumerate(range(0, n, room))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, spaced: bool = False, end_id: int = 1, room: int = 4096) -> DataFrame:
    """Packs every piece of docs(doc_id, text) into sequences of at most room tokens: _PIECES, sequence_id, offset.

    A null text counts as empty (the end id alone); a null doc_id and rows that
    repeat are documents of their own; an empty table gives no rows.
    The counts of lengths (at most `room` rows) are packed on the driver. Each
    piece's rank among those of its length then picks its place; long runs of one
    length are ranked in parts, so that no group holds more than a small share of the rows.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, tokenizer or path_of("word_bpe_49k.json"), spaced, end_id, room), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pack_counts(counts, room)
    # Places by length: ranks first.. of a length stand in bins from `bin`, `each` to a bin, from `offset`.
    taken: dict[int, int] = dict.fromkeys(counts, 0)
    places, bin_ = [], 0
    for n, filling in plan:
        offset = 0
        for length, each in filling:
            places.append((length, taken[length], each, bin_, offset))
            taken[length] += n * each
            offset += length * each
        bin_ += n
    places.sort()
    arrays = [np.array(x, np.int64) for x in zip(*places)] if places else [np.zeros(0, np.int64)] * 5
    group_rows = max(1, sum(counts.values()) // (4 * width(spark)))
    parts = spark.createDataFrame([(x, -(-n // group_rows)) for x, n in counts.items()], "length long, parts long")
    dealt = cut.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")))
    before = dealt.groupBy("length", "part").agg(F.count("*").alias("own"))
    before = before.select("length", "part", F.coalesce(F.sum("own").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("rank") - 1).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, each, bins, offset = arrays
        for f in frames:
            own, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            low, high = np.searchsorted(length, own, "left"), np.searchsorted(length, own, "right")
            while (high - low > 1).any():  # the last place of the length that starts at or before the rank
                mid = (low + high) // 2
                up = (high - low > 1) & (first[mid] <= rank)
                low, high = np.where(up, mid, low), np.where(up | (high - low <= 1), high, mid)
            nth = rank - first[low]
            yield f.drop(columns="rank").assign(sequence_id=bins[low] + nth // each[low], offset=offset[low] + nth % each[low] * own)

    return ranked.mapInPandas(place, _PIECES + ", sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
