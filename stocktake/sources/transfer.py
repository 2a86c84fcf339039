"""Files of any length: ranges of them read by tasks, and copies made of parts under a temporary name.

No content travels through a shuffle or stands in a row: tasks read a few MB at a time from
the store and write them to the store. Every step can run twice.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.functions.checksums import CRC32, shifted
from stocktake.operators.balance import balanced, in_partitions

from .files import _refused, _store, spread
from .scratch import settle

#: Bytes of one part of a copy, and of one read.
PART, CHUNK = 64 << 20, 4 << 20
_ZEROS = bytes(CHUNK)


def ranges(files: DataFrame, size: int, length: str = "length") -> DataFrame:
    """files with block, offset and length of each piece of at most `size` bytes, and n_blocks. An empty file, or one of unknown length, is one piece."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(F.col(length), F.lit(0)) / size).cast("long"))
    found = files.withColumns({"n_blocks": n, "__of": F.col(length).cast("long"), "block": F.explode(F.sequence(F.lit(0).cast("long"), n - 1))})
    return found.withColumns({"offset": F.col("block") * size, length: F.when(F.col("__of").isNotNull(), F.least(F.lit(size).cast("long"), F.col("__of") - F.col("block") * size))}).drop("__of")


def _chunks(file, offset: int, length: int | None) -> Iterator[bytes]:
    """Bytes of an open file from offset on, CHUNK at a time. An end before `length` is an error; without a length all up to the end."""
    done = 0
    while length is None or done < length:
        data = file.read_at(CHUNK if length is None else min(CHUNK, length - done), offset + done)
        if not data and length is None:
            return
        if not data:
            raise ValueError(f"{offset + done} bytes where {offset + length} were promised")
        done += len(data)
        yield data


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


def read_blocks(files: DataFrame, root: str, size: int, digest: str = "sha256") -> DataFrame:
    """path, block, offset, length, hash and message of the blocks of files(path, length) below root, at fixed offsets.

    Each block is read and digested by its task, a few MB at a time, so a long file is many tasks and none holds it; digest: a name
    of hashlib. An empty file has no block. A block that cannot be read has a message and no hash. A null length is that of
    the file, which is then one block.
    """
    import hashlib

    hashlib.new(digest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        opened, file = None, None
        for f in frames:
            rows = []
            for path, block, offset, length in zip(f["path"], f["block"], f["offset"], f["length"]):
                found, n, message = hashlib.new(digest), 0, None
                try:
                    if reason := _refused(path):
                        raise ValueError(reason)
                    if opened != path:
                        opened, file = None, store.open_input_file(f"{base}/{path}")
                        opened = path
                    for data in _chunks(file, offset, _whole(length)):
                        found.update(data)
                        n += len(data)
                except (OSError, ValueError) as e:
                    message = f"{type(e).__name__}: {e}"
                rows.append((path, block, offset, n, None if message else found.hexdigest(), message))
            yield pd.DataFrame(rows, columns=["path", "block", "offset", "length", "hash", "message"])

    found = ranges(files.select("path", F.col("length").cast("long").alias("length")).filter("length is null or length > 0"), size)
    dealt = spread(found, "path", "block").sortWithinPartitions("path", "block")
    return dealt.select("path", "block", "offset", "length").mapInPandas(run, "path string, block long, offset long, length long, hash string, message string")


class _Target:
    """Where a copy is made: one temporary file that parts are written into at their offsets, or a temporary file for each part."""

    def __init__(self, root: str, token: str, at_offsets: bool | None) -> None:
        self.store, self.base = _store(root)
        self.token = token
        self.at_offsets = self.store.type_name == "local" if at_offsets is None else at_offsets

    def path(self, dst: str) -> str:
        return f"{self.base}/{dst}"

    def part(self, dst: str, block: int | None = None) -> str:
        return f"{self.path(dst)}.{self.token}.part" + ("" if block is None or self.at_offsets else f"-{block:08d}")

    def prepare(self, dst: str, size: int) -> None:
        self.store.create_dir(self.path(dst).rpartition("/")[0], recursive=True)
        if self.at_offsets:
            with open(self.part(dst), "wb") as out:
                out.truncate(size)

    def write(self, dst: str, block: int, offset: int, chunks: Iterator[bytes]) -> None:
        """One part. At offsets, runs of zeros are left as holes, and a part whose file is published or given up is an error."""
        if not self.at_offsets:
            with self.store.open_output_stream(self.part(dst, block)) as out:
                for data in chunks:
                    out.write(data)
            return
        out = os.open(self.part(dst), os.O_WRONLY)
        try:
            for data in chunks:
                if data != _ZEROS[: len(data)]:
                    view = memoryview(data)
                    at = offset
                    while view:
                        n = os.pwrite(out, view, at)
                        view, at = view[n:], at + n
                offset += len(data)
        finally:
            os.close(out)

    def publish(self, dst: str, n_blocks: int) -> None:
        """The parts, in order, become the file: all of it at once."""
        if not self.at_offsets:
            with self.store.open_output_stream(self.part(dst)) as out:
                for block in range(n_blocks):
                    with self.store.open_input_file(self.part(dst, block)) as file:
                        for data in _chunks(file, 0, None):
                            out.write(data)
        self.store.move(self.part(dst), self.path(dst))
        self.drop(dst, n_blocks)

    def drop(self, dst: str, n_blocks: int) -> None:
        """What the parts have left behind goes."""
        for path in {self.part(dst), *(self.part(dst, i) for i in range(n_blocks))}:
            try:
                self.store.delete_file(path)
            except OSError:
                pass


_PARTS = "src string, dst string, n_blocks long, block long, phase int, bytes long, crc long, left long, stamp string, message string"


def copy_files(plan: DataFrame, src_root: str, dst_root: str, part: int = PART, partitions: int | None = None, at_offsets: bool | None = None) -> DataFrame:
    """Copies src below src_root to dst below the shared dst_root for each row of plan(src, dst, size); one row of outcome each.

    Files are cut into parts, which go to balanced partitions, the largest first and siblings apart. A file of one part is written
    and moved by its task. The parts of others are written at their offsets into one temporary file, or, on stores
    where that can't be done, to one file each which a task joins; once all are there the whole is moved into place. A file is published
    only if every part was read in full and the source had one size and time throughout. Returns src, dst, bytes,
    parts, crc32 (of the whole, combined from its parts), disposition (transferred or failed) and message: a file that
    fails leaves what was at dst, nothing of its own, and does not stop the others. A null size is found by
    reading to the end, in one part. Rows that are repeated are one; several sources for one dst all fail. Running
    the plan again gives the same files.
    """
    spark = plan.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism, 1)
    token = uuid4().hex
    target = partial(_Target, dst_root, token, at_offsets)
    rows = plan.select("src", "dst", F.col("size").cast("long").alias("size")).distinct()
    several = rows.groupBy("dst").agg(F.count("*").alias("__n")).filter("__n > 1").select("dst")
    contested = rows.join(several, "dst", "left_semi")
    pieces = ranges(rows.join(several, "dst", "left_anti").withColumn("total", F.col("size")), part, "size")
    dealt = settle(balanced(pieces, n, "dst", "size", then=["block"]), "parts")

    def attempt(row, do) -> tuple:
        """A row of _PARTS: what do() returns, or what went wrong."""
        try:
            for path in (row.src, row.dst):
                if reason := _refused(path):
                    raise ValueError(reason)
            return (row.src, row.dst, row.n_blocks, *do(), None)
        except (OSError, ValueError) as e:
            return row.src, row.dst, row.n_blocks, getattr(row, "block", None), 0, 0, None, None, None, f"{type(e).__name__}: {e}"

    def framed(found: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(found, columns=[x.split()[0] for x in _PARTS.split(", ")])
        return frame.astype({"block": "Int64", "crc": "Int64", "left": "Int64"})

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = target()
        for f in frames:
            yield framed([attempt(r, lambda r=r: (None, 0, to.prepare(r.dst, int(r.total)) or 0, None, None, None)) for r in f.itertuples()])

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, (source, base) = target(), _store(src_root)

        def one(r) -> tuple:
            length, crc, n_bytes = _whole(r.length), 0, 0
            stamp = lambda: (lambda x: f"{x.size} {x.mtime_ns}")(source.get_file_info(f"{base}/{r.src}"))
            first = stamp()

            def through(chunks: Iterator[bytes]) -> Iterator[bytes]:
                nonlocal crc, n_bytes
                for data in chunks:
                    crc, n_bytes = zlib.crc32(data, crc), n_bytes + len(data)
                    yield data

            with source.open_input_file(f"{base}/{r.src}") as file:
                chunks = through(_chunks(file, int(r.offset), length))
                if r.n_blocks > 1:
                    to.write(r.dst, int(r.block), int(r.offset), chunks)
                else:
                    own = _Target(dst_root, uuid4().hex, False)
                    own.store.create_dir(own.path(r.dst).rpartition("/")[0], recursive=True)
                    try:
                        own.write(r.dst, 0, 0, chunks)
                        if length is not None and file.size() != length:
                            raise ValueError(f"{file.size()} bytes where {length} were promised")
                        if stamp() != first:
                            raise ValueError("the source changed")
                        own.store.move(own.part(r.dst, 0), own.path(r.dst))
                    finally:
                        own.drop(r.dst, 1)
            return int(r.block), 1, n_bytes, crc, None if length is None else int(r.left), first if stamp() == first else "changed"

        for f in frames:
            yield framed([attempt(r, lambda r=r: one(r)) for r in f.itertuples()])

    parted = dealt.filter("n_blocks > 1 and block = 0").select("src", "dst", "n_blocks", "total").repartition(F.xxhash64("dst"))
    begun = settle(parted.mapInPandas(prepare, _PARTS), "begun")
    left = F.col("total") - F.col("offset") - F.col("size")
    wanted = in_partitions(dealt, n).select("src", "dst", "n_blocks", "block", "offset", F.col("size").alias("length"), left.alias("left"))
    done = settle(begun.unionByName(wanted.mapInPandas(copy, _PARTS)), "copied")

    whole = F.bit_xor(shifted("crc", F.coalesce("left", F.lit(0)), CRC32))
    size_seen = F.split(F.min("stamp"), " ")[0].cast("long")
    told = F.min_by("message", F.when(F.col("message").isNotNull(), F.struct("phase", "block"))).alias("message")
    files = done.groupBy("src", "dst", "n_blocks").agg(F.sum("bytes").alias("bytes"), F.count_if(F.col("phase") == 1).alias("parts"), whole.alias("crc32"), F.count_distinct("stamp").alias("stamps"), size_seen.alias("seen"), told)
    short = F.when((F.col("n_blocks") > 1) & (F.col("bytes") != F.col("seen")), F.concat(F.col("seen").cast("string"), F.lit(" bytes where "), F.col("bytes").cast("string"), F.lit(" were promised")))
    files = files.withColumn("message", F.coalesce("message", F.when((F.col("stamps") > 1) | (F.col("seen").isNull() & (F.col("n_blocks") > 1)), "ValueError: the source changed"), F.concat(F.lit("ValueError: "), short)))

    def publish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = target()
        for f in frames:
            found = []
            for r in f.itertuples():
                message = r.message
                try:
                    if r.n_blocks > 1 and message is None:
                        to.publish(r.dst, r.n_blocks)
                except OSError as e:
                    # a task that runs again finds the file in its place
                    if to.store.get_file_info(to.path(r.dst)).size != r.bytes or to.store.get_file_info(to.part(r.dst)).size is not None:
                        message = f"{type(e).__name__}: {e}"
                if message is not None and r.n_blocks > 1 and not _refused(r.dst):
                    to.drop(r.dst, r.n_blocks)
                found.append((r.src, r.dst, 0 if message else r.bytes, 0 if message else r.parts, None if message else r.crc32, "failed" if message else "transferred", message))
            yield pd.DataFrame(found, columns=["src", "dst", "bytes", "parts", "crc32", "disposition", "message"]).astype({"crc32": "Int64"})

    shape = "src string, dst string, bytes long, parts long, crc32 long, disposition string, message string"
    out = files.select("src", "dst", "n_blocks", "bytes", "parts", "crc32", "message").mapInPandas(publish, shape)
    refused = contested.select("src", "dst", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("parts"), F.lit(None).cast("long").alias("crc32"), F.lit("failed").alias("disposition"), F.lit("ValueError: several sources for one destination").alias("message"))
    return settle(out.unionByName(refused), "outcomes")
