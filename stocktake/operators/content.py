"""Comparing contents by digest and by blocks at equal offsets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktake.functions.checksums import CRC64NVME, crc


def _pieces(contents: DataFrame, size: int, on: Sequence[str], **values: Callable[[Column], Column]) -> DataFrame:
    """One row for each block of contents(on, content): block, offset, length and the values of its bytes.

    The slices are taken beside the content, and only what is made of them is exploded, so the work is linear in its length.
    """
    content = F.col("content").cast("binary")
    n = F.ceil(F.octet_length(content) / size).cast("int")

    def block(i: Column) -> Column:
        piece = F.substring(content, i * size + 1, F.lit(size))
        return F.struct(i.cast("long").alias("block"), (i.cast("long") * size).alias("offset"), F.octet_length(piece).cast("long").alias("length"), *(f(piece).alias(name) for name, f in values.items()))

    full = contents.filter(F.octet_length(content) > 0)
    return full.select(*on, F.explode(F.transform(F.sequence(F.lit(0), n - 1), block)).alias("b")).select(*on, "b.*")


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def split_blocks(contents: DataFrame, size: int, on: str | Sequence[str] = "doc_id") -> DataFrame:
    """Blocks of contents(on, content) at fixed offsets: block, offset, length, hash. Null and empty contents have none."""
    return _pieces(contents, size, _keys(on), hash=F.md5)


def checked_parts(contents: DataFrame, size: int, on: str = "path") -> DataFrame:
    """Parts of contents(on, content) of at most `size` bytes: block, left (the bytes that follow), crc64 and md5. An empty content is one part, a null one has none."""
    content = F.col("content").cast("binary")
    sized = contents.select(on, content.alias("content"), F.octet_length(content).cast("long").alias("__n"))
    parts = _pieces(sized, size, [on, "__n"], content=lambda piece: piece).withColumn("left", F.col("__n") - F.col("offset") - F.col("length"))
    empty = sized.filter("__n = 0").select(on, F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("left"), "content")
    return parts.select(on, "block", "left", "content").unionByName(empty).select(on, "block", "left", crc("content", CRC64NVME).alias("crc64"), F.md5("content").alias("md5"))


def zero_runs(contents: DataFrame, size: int = 4096, on: str | Sequence[str] = "doc_id") -> DataFrame:
    """Runs (first, last) of blocks of contents(on, content) that hold nothing but zero bytes: what could be holes."""
    keys = _keys(on)
    zeros = F.lit(bytes(size))
    flagged = _pieces(contents, size, keys, zero=lambda piece: piece == F.substring(zeros, F.lit(1), F.octet_length(piece)))
    return islands(flagged, "zero", *keys)


def block_join(src: DataFrame, dst: DataFrame, on: str = "doc_id") -> DataFrame:
    """Each source block with whether the destination has the same bytes at the same offset."""
    other = dst.select(on, "block", F.col("hash").alias("__hash"))
    return src.join(other, [on, "block"], "left").withColumn("reused", F.coalesce(F.col("hash") == F.col("__hash"), F.lit(False))).drop("__hash")


def block_reuse(joined: DataFrame, on: str = "doc_id") -> DataFrame:
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("length"))), F.lit(0))
    return joined.groupBy(on).agg(part(F.col("reused")).alias("bytes_reused"), part(~F.col("reused")).alias("bytes_sent"))


def islands(flagged: DataFrame, flag: str, *on: str) -> DataFrame:
    """Runs of consecutive blocks where flag holds: first, last."""
    n = F.row_number().over(Window.partitionBy(*on).orderBy("block"))
    runs = flagged.filter(flag).withColumn("__island", F.col("block") - n)
    return runs.groupBy(*on, "__island").agg(F.min("block").alias("first"), F.max("block").alias("last")).drop("__island")


def differing_ranges(joined: DataFrame, most: int, on: str = "doc_id") -> DataFrame:
    """Runs of blocks to send, split into pieces of at most `most` blocks."""
    runs = islands(joined.withColumn("__differs", ~F.col("reused")), "__differs", on)
    starts = runs.withColumn("start", F.explode(F.sequence("first", "last", F.lit(most).cast("long"))))
    return starts.select(on, "start", F.least(F.col("start") + most - 1, F.col("last")).alias("stop"))


def verify_expected(contents: DataFrame, expected: DataFrame, on: str) -> DataFrame:
    """ok, mismatch or unexpected: the digest of each content against what a mapping promised."""
    joined = contents.join(expected.select(on, F.col("hash").alias("__expected")), on, "left")
    return joined.select(on, F.when(F.col("__expected").isNull(), "unexpected").when(F.col("hash").eqNullSafe(F.lower("__expected")), "ok").otherwise("mismatch").alias("check"))


def identified(rows: DataFrame) -> Column:
    """Whether a row of rows(device, inode) can share its file with another name: it has both numbers, and not just one link where nlink is known."""
    both = F.col("device").isNotNull() & F.col("inode").isNotNull()
    return both & (F.coalesce(F.col("nlink"), F.lit(2)) > 1) if "nlink" in rows.columns else both


def representatives(links: DataFrame) -> DataFrame:
    """role of each name of an inode: the first is transferred, the others link to it. A name without an identity, as in listings of objects, stands alone and is transferred."""
    first = F.min("nth").over(Window.partitionBy("device", "inode"))
    shared = links.filter(identified(links)).withColumn("leader", first)
    alone = links.filter(~identified(links)).withColumn("leader", F.col("nth"))
    return shared.unionByName(alone).withColumn("role", F.when(F.col("nth") == F.col("leader"), "transfer").otherwise("link"))


def followers(links: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Links to make: names whose representative succeeded; outcomes: device, inode, ok."""
    return representatives(links).filter("role = 'link'").join(outcomes.filter("ok"), ["device", "inode"], "left_semi")


def group_conflicts(links: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Inodes of several names that ask for different values; by: what values have to share to be compared, such as the algorithm of a digest. Names without an identity are compared with none."""
    return links.filter(identified(links)).groupBy("device", "inode", *by).agg(F.count_distinct(value).alias("n")).filter("n > 1")
