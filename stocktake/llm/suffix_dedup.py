"""Suffix-array dedup: a logarithmic family of suffix arrays finds 50-byte strings that stand in an earlier document.

Suffixes are sampled alike in every text: of each 50-byte window, the anchor is the ANCHOR
bytes of the smallest hash, and consecutive windows with one anchor are a run. Equal windows have
equal anchors, so what can match meets where its anchor is dealt to. There the bytes of runs, and then
of windows, are sorted in byte order, and sorted lists are scanned against each other. Hashes
only deal out work and screen it: matches are found on bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches, table, width
from .shingles import mixed, powers, prefix_sums

WINDOW = 50
ANCHOR = 24
SPAN = WINDOW - ANCHOR + 1  # anchors of a window, and windows of a run at most
REACH = WINDOW + SPAN - 1  # bytes of a run at most
BATCH = 1 << 16  # suffixes of a batch, about
WINDOWS = 1 << 18  # windows that are sorted against each other at once, about
WHOLE = np.uint32(0xFFFFFFFF)  # mark of a run that stands in an earlier chunk as it is
_LOW48 = np.uint64((1 << 48) - 1)

@dataclass
class Runs:
    """Runs of windows with one anchor, in the order of places; windows first..last start in document doc."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray  # hash of the anchor's bytes
    content: np.ndarray  # hash of all bytes of the run's windows
    sums: np.ndarray

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, run) of every window of the runs `of`."""
        sizes = self.last[of] - self.first[of] + 1
        run = np.repeat(of, sizes)
        at = np.repeat(self.first[of] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        down = powers(len(self.sums))[1]
        return at, mixed((self.sums[at + WINDOW] - self.sums[at]) * down[at]), run


_PLACE_BITS = 24


def _leftmost_smallest(value: np.ndarray) -> np.ndarray:
    """The place of the leftmost smallest of each SPAN neighbours, in rounds that compare 2, 4, ... and then SPAN of them. value: 40 bits."""
    place = np.arange(len(value), dtype=np.uint64)
    small = len(value) < 1 << _PLACE_BITS
    if small:  # one number for both: the smallest value, then the leftmost place
        value = value << np.uint64(_PLACE_BITS) | place
    step = 1
    while True:
        shift = min(step, SPAN - step)
        if small:
            value = np.minimum(value[shift:], value[:-shift])
        else:
            less = value[shift:] < value[:-shift]
            value = np.where(less, value[shift:], value[:-shift])
            place = np.where(less, place[shift:], place[:-shift])
        if step + shift >= SPAN:
            break
        step *= 2
    return (value & np.uint64((1 << _PLACE_BITS) - 1) if small else place).astype(np.int64)


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Runs:
    """The runs of documents that stand from starts to ends in data."""
    sums = prefix_sums(data)
    down = powers(len(sums))[1]
    n = len(data) - WINDOW + 1
    lengths = np.maximum(ends - starts - WINDOW + 1, 0)
    if n <= 0 or not lengths.sum():
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64), sums)
    value = sums[ANCHOR:] - sums[:-ANCHOR]
    value *= down[: len(sums) - ANCHOR]
    value = mixed(value)
    place = _leftmost_smallest(value >> np.uint64(_PLACE_BITS))
    inside = np.zeros(len(place) + 1, np.int8)  # whether a window stands in one document
    long = lengths > 0
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, (starts + lengths)[long], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    place = place[at]
    doc = np.repeat(np.arange(len(starts)), lengths)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    first, last = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1]
    value, place = value[place[new]], None
    content = mixed((sums[last + WINDOW] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return Runs(doc[new], first, last, value, content, sums)


def strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int, size: int) -> np.ndarray:
    """Substrings of at most `size` bytes, as byte strings of fixed width that sort in byte order; the last byte is the length."""
    places = np.arange(size)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    out = np.empty((len(starts), size + 1), np.uint8)
    for i in range(0, len(starts), BATCH):  # rows of a view: no place of a byte is stored
        out[i : i + BATCH, :size] = sliding_window_view(padded, size)[starts[i : i + BATCH]]
    if not np.isscalar(lengths):
        out[:, :size][places >= np.asarray(lengths)[:, None]] = 0
    out[:, size] = lengths
    return out.reshape(-1).view(f"S{size + 1}")


class SuffixLevels:
    """Suffix arrays of the batches so far: leading bytes of their suffixes in byte order. A new batch becomes a level; levels of equal size merge."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []

    def seen(self, batch: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Whether each suffix of the batch stands in an earlier chunk, of this batch or of a level; the batch joins the family.

        chunk: rising. The batch is sorted, and each level is scanned alongside it: both
        are in order, and a suffix has a match where its neighbour there has all its bytes.
        """
        order = np.argsort(batch, kind="stable")
        sorted_, of = batch[order], chunk[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(batch) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        first = sorted_[new]
        known = np.zeros(len(first), bool)
        for _, level in self.levels:
            if len(level):
                at = np.searchsorted(level, first)
                at[at == len(level)] = 0
                known |= level[at] == first
        out = np.empty(len(batch), bool)
        out[order] = known[group] | (of > of[new][group])
        self._add(first[~known])
        return out

    def _add(self, level: np.ndarray) -> None:
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, other = self.levels.pop()
            level, size = np.sort(np.concatenate([other, level]), kind="stable"), size * 2  # two sorted runs merge in one pass
        self.levels.append((size, level))


def _among(values: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """Whether each value is one of the rising ones."""
    if not len(rising):
        return np.zeros(len(values), bool)
    return rising[np.minimum(np.searchsorted(rising, values), len(rising) - 1)] == values


def _batches(chunk: np.ndarray, size: int) -> Iterator[slice]:
    """Whole chunks in order, about `size` rows at a time."""
    cuts = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]]) if len(chunk) else np.zeros(1, np.int64)
    start = 0
    for stop in cuts[1:].tolist():
        if stop - start >= size or stop == len(chunk):
            yield slice(start, stop)
            start = stop


def marks_of(data: np.ndarray, lengths: np.ndarray, anchors: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """For each run (bytes that stand one after the other in data) of chunks in order, which of its windows stand in an earlier chunk.

    A bit for each window, or WHOLE. Runs are suffixes of at most REACH bytes; those
    that are not known as a whole, and whose anchor has other runs as well, are parted into windows.
    """
    starts = np.cumsum(lengths) - lengths
    known = np.zeros(len(lengths), bool)
    levels = SuffixLevels()
    for part in _batches(chunk, BATCH):
        known[part] = levels.seen(strings(data, starts[part], lengths[part], REACH), chunk[part])
    marks = np.where(known, WHOLE, np.uint32(0))
    fresh = np.sort(anchors[~known])
    several = fresh[1:][fresh[1:] == fresh[:-1]]
    open_ = np.flatnonzero(~known & _among(anchors, several))
    n = lengths - WINDOW + 1
    parts = max(1, math.ceil(int(n[open_].sum()) / WINDOWS))
    dealt = (mixed(anchors[open_].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    for i in range(parts):
        own = open_[dealt == i]  # windows match only where anchors do
        levels = SuffixLevels()
        for part in _of_runs(chunk[own], n[own]):
            mine = own[part]
            sizes = n[mine]
            before = np.cumsum(sizes) - sizes
            nth = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
            at = np.repeat(starts[mine], sizes) + nth
            seen = levels.seen(strings(data, at, WINDOW, WINDOW), np.repeat(chunk[mine], sizes))
            marks[mine] = np.bitwise_or.reduceat(seen.astype(np.uint32) << nth.astype(np.uint32), before)
    return marks


def _of_runs(chunk: np.ndarray, n: np.ndarray) -> Iterator[slice]:
    """Runs of whole chunks in order, with about BATCH windows at a time."""
    total, start = np.cumsum(n), 0
    for part in _batches(chunk, 1):
        done = int(total[start - 1]) if start else 0
        if int(total[part.stop - 1]) - done >= BATCH or part.stop == len(chunk):
            yield slice(start, part.stop)
            start = part.stop


def _packed(x: np.ndarray, size: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :size] = rows
    return out.reshape(-1).view("<u8")


def _grouped(keys: list[np.ndarray], text: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(group of each item, first item of each group): items of equal keys, last key first, whose texts are equal to the bytes."""
    order = np.lexsort(keys)
    differs = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        differs[1:] |= k[1:] != k[:-1]
    if len(order):
        differs[0] = True
    head = order[np.maximum.accumulate(np.where(differs, np.arange(len(order)), 0))]
    rest = np.flatnonzero(~differs)
    parts = (rest[i : i + BATCH] for i in range(0, len(rest), BATCH))  # texts take many times the room of keys
    odd = np.concatenate([rest[:0], *(x[text(order[x]) != text(head[x])] for x in parts)])
    if len(odd):  # keys that collide: their items are grouped by text alone
        number = np.cumsum(differs) - 1
        bad = np.flatnonzero(np.isin(number, number[odd]))
        values, of = np.unique(text(order[bad]), return_inverse=True)
        again = np.lexsort((of.reshape(-1), number[bad]))
        order[bad] = order[bad][again]
        of, number = of.reshape(-1)[again], number[bad][again]
        differs[bad] = np.concatenate([[True], (of[1:] != of[:-1]) | (number[1:] != number[:-1])])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(differs) - 1
    return group, order[differs]


class Chunk:
    """The documents of one chunk, its anchors in the order in which buckets get them, and its entries: runs of different bytes."""

    def __init__(self, row, buckets: int, bits: int) -> None:
        self.ids = np.frombuffer(row["doc_ids"], "<i8")
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["payload"], max_output_size=max(1, int(lengths.sum()))), np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.runs = r = runs(self.data, self.starts, self.ends)
        self.buckets, self.mask = buckets, np.uint64((1 << 64) - (1 << (64 - bits)))
        self.lengths = r.last + WINDOW - r.first
        # anchors are smallest hashes, so their own high bits are not even; buckets rise with the remixed ones
        self.spread = mixed(r.anchor) & self.mask
        rising = np.sort(self.spread)
        self.anchors = rising[np.concatenate([[True], rising[1:] != rising[:-1]])] if len(rising) else rising

    def group(self) -> None:
        """entry: of each run; heads: a run of each entry, by rising anchors; anchor_of: the anchor of each run."""
        r = self.runs
        self.anchor_of = np.searchsorted(self.anchors, self.spread)
        self.entry, self.heads = _grouped([r.content & self.mask, self.spread], lambda i: strings(self.data, r.first[i], self.lengths[i], REACH))

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)

    def parts(self, hashes: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Buckets and the part of rising hashes that each gets."""
        bucket = self.bucket(hashes)
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
        return ((int(bucket[a]), slice(a, b)) for a, b in zip(cuts.tolist(), cuts[1:].tolist()))

    def returned(self, rows: pd.DataFrame, hashes: np.ndarray, read: Callable[[bytes, int], np.ndarray], kind) -> np.ndarray:
        """What buckets returned for the hashes that they got."""
        out = np.zeros(len(hashes), kind)
        got = dict(zip(rows["bucket"].tolist(), rows["data"].tolist()))
        for i, own in self.parts(hashes):
            out[own] = read(got[i], own.stop - own.start)
        return out

    def sent(self, shared: np.ndarray) -> np.ndarray:
        """Entries whose anchor stands in several chunks."""
        return np.flatnonzero(shared[self.anchor_of[self.heads]])

    def _dealt(self, of: np.ndarray) -> Iterator[np.ndarray]:
        """The runs `of` in parts of about WINDOWS windows; runs of one anchor, whose windows may be equal, are in one."""
        r = self.runs
        parts = math.ceil(int((r.last[of] - r.first[of] + 1).sum()) / WINDOWS)
        dealt = mixed(r.anchor[of]) % np.uint64(max(1, parts))
        return (of[dealt == np.uint64(i)] for i in range(parts))

    def removed(self, marks: np.ndarray) -> np.ndarray:
        """Bytes covered by windows that start in an earlier document, of this chunk or one before. marks: of entries."""
        r, ids, mark = self.runs, self.ids, marks[self.entry]
        least = np.full(len(self.heads), np.iinfo(np.int64).max)
        np.minimum.at(least, self.entry, ids[r.doc])
        whole = (mark == WHOLE) | (least[self.entry] < ids[r.doc])
        edge = np.zeros(len(self.data) + 1, np.int64)
        np.add.at(edge, r.first[whole], 1)
        np.add.at(edge, r.last[whole] + WINDOW, -1)
        # windows of runs whose anchor has several entries here, or of which a bucket knows some
        entries = np.bincount(self.anchor_of[self.heads], minlength=len(self.anchors))
        open_ = (mark != WHOLE) & ((entries[self.anchor_of] > 1) | (mark != 0))
        for own in self._dealt(np.flatnonzero(open_)):
            at, hashes, run = r.windows(own)
            hit = (mark[run] >> (at - r.first[run]).astype(np.uint32) & np.uint32(1)).astype(bool)
            group, heads = _grouped([hashes & self.mask], lambda i: strings(self.data, at[i], WINDOW, WINDOW))
            least = np.full(len(heads), np.iinfo(np.int64).max)
            np.minimum.at(least, group, ids[r.doc[run]])
            hit |= least[group] < ids[r.doc[run]]
            np.add.at(edge, at[hit], 1)
            np.add.at(edge, at[hit] + WINDOW, -1)
        return np.cumsum(edge[:-1]) > 0


_CHUNK = "chunk long, doc_ids binary, lengths binary, payload binary"
_ANCHORS = "bucket int, chunk long, anchors binary"
_ENTRIES = "bucket int, chunk long, anchors binary, lengths binary, runs binary"
_BACK = "bucket int, chunk long, step int, data binary"


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _marks(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, 4 * n)), "<u4")


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """Documents in ascending doc_id order, in rows of about `size` bytes; equal ids stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        texts: list[bytes] = []

        def row() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], "<i8").tobytes()
            payload = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            return pa.RecordBatch.from_pydict({"chunk": [(part << 32) + nth], "doc_ids": [np.array(ids, "<i8").tobytes()], "lengths": [lengths], "payload": [payload]}, pa.schema([("chunk", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())]))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held >= size and doc != ids[-1]:
                    yield row()
                    nth, held, ids, texts = nth + 1, 0, [], []
                ids.append(doc)
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
        if ids:
            yield row()

    return docs.repartitionByRange("doc").sortWithinPartitions("doc").mapInArrow(run, _CHUNK)


def deduplicated(docs: DataFrame, chunk_bytes: int = 2_000_000, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (its spans, binary pairs of 64-bit places) for docs(doc_id, text).

    Whole texts as UTF-8 bytes. A byte is removed if a string of 50 bytes that covers
    it also starts in a document with a smaller doc_id, judged on the input. A null text is empty and
    texts under 50 bytes stay whole. Rows without a doc_id are left out; rows that
    repeat do not remove each other; an empty table gives no rows.

    Batches are chunks of documents in ascending order. Anchors that only one chunk has
    are screened out by hash; the runs of the others are sent, once each, with their bytes to hash buckets.
    There a logarithmic family of suffix arrays takes them in order and says which
    stand in an earlier chunk. bits: how many bits of hashes are used; fewer make more candidates and no other result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).filter(F.col("doc").isNotNull())
    chunks = settle(_chunks(docs, chunk_bytes), "chunks")
    total = chunks.agg(F.count("*")).first()[0] * chunk_bytes
    buckets = max(width(spark), math.ceil(total / 16_000_000))

    def screen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                c = Chunk(row, buckets, bits)
                yield pd.DataFrame([(i, row["chunk"], _packed(c.anchors[own] & _LOW48, 6)) for i, own in c.parts(c.anchors)], columns=["bucket", "chunk", "anchors"])

    def shared(f: pd.DataFrame) -> pd.DataFrame:
        own = [_unpacked(x, 6) for x in f["anchors"]]
        every = np.sort(np.concatenate(own))
        several = every[1:][every[1:] == every[:-1]]
        rows = [(i, c, 0, np.packbits(_among(x, several)).tobytes()) for i, c, x in zip(f["bucket"], f["chunk"], own)]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "step", "data"])

    def send(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in own.to_dict("records"):
            c = Chunk(row, buckets, bits)
            c.group()
            heads = c.heads[c.sent(c.returned(back, c.anchors, _bits, bool))]
            spread, lengths = c.spread[heads], c.lengths[heads].astype(np.uint8)
            text = strings(c.data, c.runs.first[heads], lengths, REACH).view(np.uint8).reshape(-1, REACH + 1)[:, :REACH]
            inside = np.arange(REACH) < lengths[:, None]
            for i, part in c.parts(spread):
                rows.append((i, row["chunk"], spread[part].astype("<u4").tobytes(), lengths[part].tobytes(), zstandard.ZstdCompressor(level=1).compress(text[part][inside[part]].tobytes())))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "anchors", "lengths", "runs"])

    def scan(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("chunk")
        lengths = [np.frombuffer(x, np.uint8).astype(np.int64) for x in f["lengths"]]
        text = b"".join(zstandard.ZstdDecompressor().decompress(x, max_output_size=max(1, int(n.sum()))) for x, n in zip(f["runs"], lengths))
        anchors = np.frombuffer(b"".join(f["anchors"]), "<u4")
        sizes = [len(x) for x in lengths]
        marks = marks_of(np.frombuffer(text, np.uint8), np.concatenate(lengths), anchors, np.repeat(np.arange(len(f)), sizes))
        parts = np.split(marks.astype("<u4"), np.cumsum(sizes)[:-1])
        rows = [(i, c, 1, zstandard.ZstdCompressor(level=1).compress(x.tobytes())) for i, c, x in zip(f["bucket"], f["chunk"], parts)]
        return pd.DataFrame(rows, columns=["bucket", "chunk", "step", "data"])

    def finish(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in own.to_dict("records"):
            c = Chunk(row, buckets, bits)
            c.group()
            sent = c.sent(c.returned(back[back["step"] == 0], c.anchors, _bits, bool))
            marks = np.zeros(len(c.heads), np.uint32)
            marks[sent] = c.returned(back[back["step"] == 1], c.spread[c.heads[sent]], _marks, np.uint32)
            gone = c.removed(marks)
            for doc, a, b in zip(c.ids.tolist(), c.starts.tolist(), c.ends.tolist()):
                mark = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))).astype("<i8")
                rows.append((doc, b - a, int(mark.sum()), len(edges) // 2, hashlib.sha256(c.data[a:b][~mark].tobytes()).hexdigest(), edges.tobytes()))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    back = settle(chunks.mapInPandas(screen, _ANCHORS).groupBy("bucket").applyInPandas(shared, _BACK), "bits")
    own = lambda: chunks.select(*(F.col(c).alias(c) for c in chunks.columns)).groupBy("chunk")
    sent = own().cogroup(back.groupBy("chunk")).applyInPandas(send, _ENTRIES)
    marks = settle(sent.groupBy("bucket").applyInPandas(scan, _BACK), "marks")
    return own().cogroup(back.union(marks).groupBy("chunk")).applyInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed binary")


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")
