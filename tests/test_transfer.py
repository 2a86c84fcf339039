"""Ranged reads and copies of parts: same bytes, bounded memory, failures alone, repeats."""

import hashlib
import os
import resource
import stat
import zlib

import pytest
from pyspark.sql import functions as F

from stocktake.sources import transfer

PLAN = "src string, dst string, size long"


@pytest.fixture
def tree(tmp_path):
    sizes = {"a/small.bin": 10, "a/empty.bin": 0, "b/exact.bin": 8192, "b/long.bin": 50_001, "c/zeros.bin": 30_000}
    for i, (path, n) in enumerate(sizes.items()):
        at = tmp_path / "src" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"\0" * n if "zeros" in path else hashlib.shake_128(bytes([i])).digest(n))
    (tmp_path / "dst").mkdir()
    return tmp_path, sizes


def left_over(folder):
    return [x for _, _, names in os.walk(folder) for x in names if ".part" in x]


def test_ranges(spark):
    files = spark.createDataFrame([("a", 0), ("b", 10), ("c", 11), ("d", None)], "path string, length long")
    got = sorted((r.path, r.block, r.offset, r.length, r.n_blocks) for r in transfer.ranges(files, 5).collect() if r.path != "d")
    assert got == [("a", 0, 0, 0, 1), ("b", 0, 0, 5, 2), ("b", 1, 5, 5, 2), ("c", 0, 0, 5, 3), ("c", 1, 5, 5, 3), ("c", 2, 10, 1, 3)]
    assert [(r.length, r.n_blocks) for r in transfer.ranges(files.filter("path = 'd'"), 5).collect()] == [(None, 1)]


def test_blocks_are_read_by_range(spark, tree):
    root, sizes = tree
    listed = [(p, n) for p, n in sizes.items()] + [("gone.bin", 5), ("../dst", 1), ("a/small.bin", 12)]
    rows = transfer.read_blocks(spark.createDataFrame(listed, "path string, length long"), str(root / "src"), 4096, "md5").collect()
    want = {}
    for p in sizes:
        data = (root / "src" / p).read_bytes()
        want |= {(p, i // 4096, i): (len(data[i : i + 4096]), hashlib.md5(data[i : i + 4096]).hexdigest()) for i in range(0, len(data), 4096)}
    assert {(r.path, r.block, r.offset): (r.length, r.hash) for r in rows if r.message is None} == want
    failed = {r.path: r.message for r in rows if r.message}
    assert set(failed) == {"gone.bin", "../dst", "a/small.bin"} and all(r.hash is None for r in rows if r.message)
    assert "10 bytes where 12" in failed["a/small.bin"] and "leaves its root" in failed["../dst"]
    unknown = transfer.read_blocks(spark.createDataFrame([("b/long.bin", None)], "path string, length long"), str(root / "src"), 4096).collect()
    assert [(r.length, r.hash) for r in unknown] == [(50_001, hashlib.sha256((root / "src/b/long.bin").read_bytes()).hexdigest())]


@pytest.mark.parametrize("at_offsets", [None, False], ids=["one temporary file", "a file for each part"])
def test_copies_are_the_same_bytes_and_fail_alone(spark, tree, at_offsets):
    root, sizes = tree
    (root / "dst/old.bin").write_bytes(b"old")
    (root / "dst/a").mkdir()
    (root / "dst/a/small.bin").write_bytes(b"before")
    plan = [(p, p, n) for p, n in sizes.items()] + [("a/small.bin", "a/small.bin", 10), ("b/long.bin", "again/long.bin", None), ("b/long.bin", "old.bin", 60_000), ("b/long.bin", "cut.bin", 40_000), ("gone", "x.bin", 9000), ("a/small.bin", "twice.bin", 10), ("b/exact.bin", "twice.bin", 8192), ("a/small.bin", "../out.bin", 10), ("b/long.bin", "a/small.bin/below", 50_001)]
    copy = lambda: {r.dst: r for r in transfer.copy_files(spark.createDataFrame(plan, PLAN), str(root / "src"), str(root / "dst"), part=4096, partitions=3, at_offsets=at_offsets).select("*").collect()}
    for _ in range(2):  # running it again gives the same
        got = copy()
        for p, n in sizes.items():
            data = (root / "src" / p).read_bytes()
            assert (root / "dst" / p).read_bytes() == data
            assert (got[p].disposition, got[p].bytes, got[p].parts, got[p].crc32, got[p].message) == ("transferred", n, max(1, -(-n // 4096)), zlib.crc32(data), None)
        assert (root / "dst/again/long.bin").read_bytes() == (root / "src/b/long.bin").read_bytes() and got["again/long.bin"].parts == 1
        failed = {d for d, r in got.items() if r.disposition == "failed"}
        assert failed == {"old.bin", "cut.bin", "x.bin", "twice.bin", "../out.bin", "a/small.bin/below"} and all(got[d].message and got[d].bytes == 0 for d in failed)
        assert (root / "dst/old.bin").read_bytes() == b"old" and not (root / "dst/cut.bin").exists() and not (root / "out.bin").exists()
        assert left_over(root) == []
    assert transfer.copy_files(spark.createDataFrame([], PLAN), str(root / "src"), str(root / "dst")).count() == 0


def test_a_part_that_fails_leaves_the_old_file_and_a_rerun_mends_it(spark, tree):
    root, sizes = tree
    plan = spark.createDataFrame([("b/long.bin", "long.bin", 50_001)], PLAN)
    source = root / "src/b/long.bin"
    data = source.read_bytes()
    (root / "dst/long.bin").write_bytes(b"old")
    source.write_bytes(data[:20_000])  # the later parts are not there
    first = transfer.copy_files(plan, str(root / "src"), str(root / "dst"), part=4096).first()
    assert first.disposition == "failed" and (root / "dst/long.bin").read_bytes() == b"old" and left_over(root) == []
    source.write_bytes(data)
    assert transfer.copy_files(plan, str(root / "src"), str(root / "dst"), part=4096).first().crc32 == zlib.crc32(data)
    assert (root / "dst/long.bin").read_bytes() == data


def test_parts_and_publishing_can_run_twice(tmp_path):
    to = transfer._Target(str(tmp_path), "t", None)
    to.prepare("f", 8)
    for _ in range(2):
        to.write("f", 1, 4, iter([b"wxyz"]))
        to.write("f", 0, 0, iter([b"abcd"]))
    to.publish("f", 2)
    assert (tmp_path / "f").read_bytes() == b"abcdwxyz"
    with pytest.raises(OSError):
        to.write("f", 0, 0, iter([b"late"]))  # an attempt that lives on finds no file to write into
    assert sorted(os.listdir(tmp_path)) == ["f"]


def test_a_long_sparse_file_needs_little_memory(spark, tmp_path):
    (tmp_path / "src").mkdir()
    size, marks = 3 << 30, {0: b"first", (1 << 30) + 17: b"middle", (3 << 30) - 4: b"last"}
    with open(tmp_path / "src/big.bin", "wb") as out:
        out.truncate(size)
        for at, mark in marks.items():
            out.seek(at)
            out.write(mark)
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    plan = spark.createDataFrame([("big.bin", "to/big.bin", size)], PLAN)
    done = transfer.copy_files(plan, str(tmp_path / "src"), str(tmp_path), part=256 << 20).first()
    assert (done.disposition, done.bytes, done.parts) == ("transferred", size, 12)
    copied = tmp_path / "to/big.bin"
    assert copied.stat().st_size == size and copied.stat().st_blocks * 512 < 64 << 20 and not stat.S_ISLNK(copied.stat().st_mode)
    with open(copied, "rb") as file:
        for at, mark in marks.items():
            file.seek(at)
            assert file.read(len(mark)) == mark
    blocks = transfer.read_blocks(spark.createDataFrame([("to/big.bin", size)], "path string, length long"), str(tmp_path), 1 << 30, "md5")
    source = transfer.read_blocks(spark.createDataFrame([("src/big.bin", size)], "path string, length long"), str(tmp_path), 1 << 30, "md5")
    assert blocks.select("block", "hash").exceptAll(source.select("block", "hash")).count() == 0 and blocks.count() == 3
    assert max(before, resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss) < 1 << 20  # KB: no worker came near the file's size


def test_the_sum_of_parts(spark):
    from stocktake.functions import checksums as C

    data = os.urandom(5000)
    assert C.CRC32.of(data) == zlib.crc32(data) and C.CRC64NVME.of(b"123456789") == 0xAE8B14860A799888 and C.CRC64NVME.of(b"") == C.CRC32.of(b"") == 0
    for size in (1, 7, 1000, 4999, 5000, 9000):
        pieces = [(i, len(data) - i - len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)][::-1]
        rows = spark.createDataFrame(pieces, "at long, left long, content binary").repartition(3)
        for kind in (C.CRC32, C.CRC64NVME):
            got = rows.agg(C.combined(C.crc("content", kind), "left", kind)).first()[0]
            assert got % (1 << 64) == kind.of(data)
    assert spark.createDataFrame([(None, 3)], "crc long, left long").select(C.shifted("crc", "left", C.CRC32)).first()[0] is None
    assert spark.range(1).select(C.etag_of_parts(F.array(F.md5(F.lit("ab")), F.md5(F.lit("c"))))).first()[0] == hashlib.md5(hashlib.md5(b"ab").digest() + hashlib.md5(b"c").digest()).hexdigest() + "-2"


def test_checksums_of_many_parts_are_looked_up_side_by_side():
    import time

    from stocktake.functions import checksums as C

    parts = [os.urandom(n) for n in (0, 1, 511, 512, 513, 5000, 0, (4 << 20) + 3, 9)]
    assert C.CRC32.each(parts).tolist() == [zlib.crc32(x) for x in parts] and C.CRC32.each([]).tolist() == C.CRC32.each([b""])[1:].tolist()
    many, began = [os.urandom(512)] * 8000, time.process_time()
    assert set(C.CRC64NVME.each(many).tolist()) == {C.CRC64NVME.of(many[0])}
    assert time.process_time() - began < 2  # one by one they took about 1 ms each
