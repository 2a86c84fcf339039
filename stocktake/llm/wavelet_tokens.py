"""Token files as wavelet matrices: succinct bit-planes with rank and select, one compressed file for each range of documents."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, small_batches, table
from .tokens import encoder, path_of

_HEAD = struct.Struct("<4sBQ")
_BLOCK = 512  # bits that one entry of a plane's rank directory covers


class WaveletMatrix:
    """A sequence of ids as bit-planes, highest bit first; each plane parts the sequence stably, zeros first.

    A plane is stored with its rank directory: how many ones stand before each block.
    Places and tokens may be numbers or arrays.
    """

    def __init__(self, planes: list[np.ndarray], ranks: list[np.ndarray], n: int) -> None:
        self.planes, self.ranks, self.n = planes, ranks, n  # planes: rows of 64-bit words, one row for each block

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, ranks, blocks = [], [], -(-len(ids) // _BLOCK)
        for level in range(bits - 1, -1, -1):
            ones = (ids >> level) & 1 == 1
            plane = np.zeros(blocks * _BLOCK // 8, np.uint8)
            packed = np.packbits(ones, bitorder="little")
            plane[: len(packed)] = packed
            planes.append(plane.view("<u8").reshape(blocks, _BLOCK // 64))
            ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(planes[-1]).sum(axis=1, dtype=np.int64))]).astype("<u4"))
            if level:
                # by places: on bits without runs a mask takes several times as long
                ids = np.concatenate([ids.take(np.flatnonzero(~ones)), ids.take(np.flatnonzero(ones))])
        return cls(planes, ranks, len(ids))

    def bytes(self) -> bytes:
        return _HEAD.pack(b"WMX2", len(self.planes), self.n) + b"".join(r.tobytes() + p.tobytes() for p, r in zip(self.planes, self.ranks))

    @classmethod
    def read(cls, data: bytes) -> WaveletMatrix:
        mark, bits, n = _HEAD.unpack_from(data)
        if mark != b"WMX2":
            raise ValueError("not a wavelet matrix file")
        blocks, at, planes, ranks = -(-n // _BLOCK), _HEAD.size, [], []
        for _ in range(bits):
            ranks.append(np.frombuffer(data, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
            planes.append(np.frombuffer(data, "<u8", blocks * _BLOCK // 64, at).reshape(blocks, _BLOCK // 64))
            at += blocks * _BLOCK // 8
        return cls(planes, ranks, n)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level].view(np.uint8).reshape(-1), count=self.n, bitorder="little").view(bool)

    def decode(self, kind: np.dtype) -> np.ndarray:
        """The whole sequence: the planes are undone from the lowest."""
        ids = np.zeros(self.n, kind)
        last = len(self.planes) - 1
        for level in range(last, -1, -1):
            ones = self._bits(level)
            if level == last:
                ids[ones] = 1
                continue
            zeros = self.n - int(np.count_nonzero(ones))
            back = np.empty_like(ids)
            # what the next planes hold is in parted order: zeros first
            back[np.flatnonzero(~ones)] = ids[:zeros]
            back[np.flatnonzero(ones)] = ids[zeros:] | kind.type(1 << (last - level))
            ids = back
        return ids

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place: the directory's count, whole words of the block, and part of one word."""
        block, rest = at // _BLOCK, at % _BLOCK
        out = self.ranks[level][block].astype(np.int64)
        inside = np.flatnonzero(rest)
        if len(inside):
            words, word = self.planes[level][block[inside]], rest[inside] // 64
            counts = np.where(np.arange(_BLOCK // 64) < word[:, None], np.bitwise_count(words), 0).sum(axis=1, dtype=np.int64)
            part = words[np.arange(len(inside)), word] & ((np.uint64(1) << (rest[inside] % 64).astype(np.uint64)) - np.uint64(1))
            out[inside] += counts + np.bitwise_count(part)
        return out

    def _zeros(self, level: int) -> int:
        return self.n - int(self.ranks[level][-1])

    def _path(self, token: int) -> list[int]:
        return [token >> (len(self.planes) - 1 - level) & 1 for level in range(len(self.planes))]

    def access(self, at: int | np.ndarray) -> int | np.ndarray:
        """The token at each place."""
        i = np.atleast_1d(np.asarray(at, np.int64))
        token = np.zeros(len(i), np.int64)
        for level, plane in enumerate(self.planes):
            bit = (plane[i // _BLOCK, i % _BLOCK // 64] >> (i % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, i)
            i = np.where(bit == 1, self._zeros(level) + ones, i - ones)
            token = token << 1 | bit
        return token if np.ndim(at) else int(token[0])

    def rank(self, token: int, at: int | np.ndarray) -> int | np.ndarray:
        """How often the token stands before each place."""
        i = np.atleast_1d(np.asarray(at, np.int64))
        start = np.zeros(1, np.int64)
        if token >> len(self.planes):
            i = np.zeros(len(i), np.int64)
        else:
            for level, bit in enumerate(self._path(token)):
                a, b = self._ones(level, start), self._ones(level, i)
                start, i = (self._zeros(level) + a, self._zeros(level) + b) if bit else (start - a, i - b)
        return i - start if np.ndim(at) else int((i - start)[0])

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int | np.ndarray) -> int | np.ndarray:
        """The place of the token's kth occurrence, k from 0."""
        path, start = self._path(token), np.zeros(1, np.int64)
        for level, bit in enumerate(path):
            a = self._ones(level, start)
            start = self._zeros(level) + a if bit else start - a
        at = start + np.atleast_1d(np.asarray(k, np.int64))
        for level in range(len(path) - 1, -1, -1):
            bit, nth = path[level], at - (self._zeros(level) if path[level] else 0)
            low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n)  # the least place with more than nth such bits up to it
            while (low < high).any():
                mid = (low + high) // 2
                ones = self._ones(level, np.minimum(mid + 1, self.n))
                enough = (ones if bit else mid + 1 - ones) > nth
                low, high = np.where((low < high) & ~enough, mid + 1, low), np.where((low < high) & enough, mid, high)
            at = low
        return at if np.ndim(k) else int(at[0])

    def occurrences(self, token: int) -> list[int]:
        return self.select(token, np.arange(self.count(token))).tolist()


SHARD = "part int, shard int, before long, n_tokens long, doc_ids binary, lengths binary, matrix binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, spaced: bool, end_id: int | None, shard_tokens: int = 2_000_000) -> None:
    """Encodes every text of docs(doc_id, text) and writes the ids in ascending doc_id order as Parquet files of wavelet matrices.

    Documents are dealt to tasks by ranges of doc_id; each task writes one
    compressed file, in shards of about shard_tokens tokens that begin and end with
    a document. A null text counts as empty, a null doc_id comes first, rows that
    repeat are kept. An empty table makes no shard.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer, spaced)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        own: list = []
        held = 0
        bits = max(len(work.edge) - 1, end_id or 0).bit_length()
        end = np.array([] if end_id is None else [end_id], work.kind)

        def packed() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in own], "<i8")
            matrix = WaveletMatrix.build(np.concatenate(own), bits).bytes()
            nulls = np.array([x is None for x in ids], "u1").tobytes()
            known = np.array([x or 0 for x in ids], "<i8").tobytes()
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "before": before, "n_tokens": held, "doc_ids": nulls + known, "lengths": lengths.tobytes(), "matrix": matrix}], schema)

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("matrix", pa.binary())])
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), work.texts(batch.column(1))):
                ids.append(doc_id)
                own.append(np.concatenate([x, end]))
                held += len(own[-1])
                if held >= shard_tokens:
                    yield packed()
                    shard, before, held, ids, own = shard + 1, before + held, 0, [], []
        if ids:
            yield packed()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, SHARD).write.option("compression", "zstd").parquet(path)


def _earlier(shards: DataFrame) -> DataFrame:
    """Tokens before each part. One row for each written file, so the window over all of them is small."""
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    return sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))


def read_tokens(spark, path: str, end_id: int | None = 2) -> DataFrame:
    """Each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids as 32-bit integers, first_token and n_end.

    first_token is looked up at the document's first place, n_end counts end_id between its ends by rank; both are
    null without an end id. A null doc_id and rows that repeat come back as they were written; an empty table gives no rows.
    """
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i8")
                nulls = np.frombuffer(row["doc_ids"], "u1", len(lengths)) == 1
                doc_ids = np.frombuffer(row["doc_ids"], "<i8", len(lengths), len(lengths))
                matrix = WaveletMatrix.read(row["matrix"])
                data = memoryview(matrix.decode(np.dtype("<u2" if len(matrix.planes) <= 16 else "<u4")).astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                none = pa.nulls(len(lengths), pa.int64())
                # a document has its end id at least, so its first place holds a token
                first = pa.array(matrix.access(ends - lengths)) if end_id is not None else none
                closed = pa.array(matrix.rank(end_id, ends) - matrix.rank(end_id, ends - lengths)) if end_id is not None else none
                columns = [pa.array(doc_ids, mask=nulls), pa.array(row["before"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), first, closed, pa.array(np.full(len(lengths), row["part"], "i4"))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "first_token", "n_end", "part"])

    shards = spark.read.schema(SHARD).parquet(path)
    docs = shards.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, first_token long, n_end long, part int")
    return docs.join(_earlier(shards), "part").select("doc_id", (F.col("start") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32", "first_token", "n_end")


def _placed(spark, path: str) -> DataFrame:
    """Shards with the place of their first token among all."""
    shards = spark.read.schema(SHARD).parquet(path)
    return shards.join(_earlier(shards), "part").withColumn("start", F.col("before") + F.col("earlier"))


def tokens_at(spark, path: str, places: DataFrame, span: int = 1 << 21) -> DataFrame:
    """place and token for places(place long); a place beyond the files has no row. Only shards that hold a place are opened.

    Shards and places meet in spans of `span` tokens; the places of one span and shard are looked up together.
    """
    shards = _placed(spark, path).filter("n_tokens > 0")
    ranges = shards.select("part", "shard", F.col("start").alias("low"), (F.col("start") + F.col("n_tokens")).alias("high"))
    ranges = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / span), F.floor((F.col("high") - 1) / span))))
    asked = places.select(F.col("place").cast("long").alias("place")).filter("place >= 0").distinct().withColumn("bin", F.floor(F.col("place") / span))
    met = asked.join(ranges, "bin").filter("place >= low and place < high").select("part", "shard", "place", "low")

    def look(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if own.empty or ask.empty:
            return pd.DataFrame({"place": [], "token": []}, dtype="int64")
        matrix = WaveletMatrix.read(own["matrix"].iloc[0])
        return pd.DataFrame({"place": ask["place"], "token": matrix.access((ask["place"] - ask["low"]).to_numpy())})

    # aliases tell the columns of both sides apart, which come from the same files
    held = shards.select(F.col("part").alias("part"), F.col("shard").alias("shard"), F.col("matrix").alias("matrix"))
    matrices = held.join(met.select("part", "shard").distinct(), ["part", "shard"], "left_semi")
    return matrices.groupBy("part", "shard").cogroup(met.groupBy("part", "shard")).applyInPandas(look, "place long, token long")


def token_counts(spark, path: str, tokens: Sequence[int]) -> DataFrame:
    """token and n of a list of tokens: counted in each shard by rank, no shard is decoded. A token that never stands there has n 0."""
    wanted = [int(t) for t in tokens]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.read(row["matrix"])
                yield pa.RecordBatch.from_pydict({"token": wanted, "n": [matrix.count(t) for t in wanted]}, pa.schema([("token", pa.int64()), ("n", pa.int64())]))

    found = spark.read.schema(SHARD).parquet(path).select("matrix").mapInArrow(count, "token long, n long")
    return spark.createDataFrame([(t, 0) for t in wanted], "token long, n long").unionByName(found).groupBy("token").agg(F.sum("n").alias("n"))


def token_occurrences(spark, path: str, token: int) -> DataFrame:
    """Every place at which a token stands, by select in each shard."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.read(row["matrix"])
                yield pa.RecordBatch.from_pydict({"place": row["start"] + matrix.select(token, np.arange(matrix.count(token)))}, pa.schema([("place", pa.int64())]))

    return _placed(spark, path).select("matrix", "start").mapInArrow(find, "place long")


def token_files(docs: DataFrame, tokenizer: str | None = None, spaced: bool = True, end_id: int | None = 2) -> DataFrame:
    """Writes docs as token files in the shared folder and returns what the files hold, by document.

    Nulls, ties, repeated rows and empty tables are as write_tokens and read_tokens say.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_tokens(docs, path, tokenizer or path_of("byte_bpe_50k.json"), spaced, end_id)
    return read_tokens(spark, path, end_id)


def query(spark, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))
