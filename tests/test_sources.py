"""Files and records: what must never be lost, what fails alone, and what a reader refuses."""

import os
import time

import pytest
from pyspark.sql import functions as F

from stocktake.functions import values as V
from stocktake.operators import mapping as M
from stocktake.operators import reconcile
from stocktake.operators.ordering import numbered
from stocktake.sources import files, records, scratch
from stocktake.sources.derived import Tables
from stocktake.streaming import logs


@pytest.fixture
def tree(tmp_path):
    for path in ("a/one.txt", "a/b/two.txt", "a/b/kept.txt", "c/three.tmp", "d/e/four.txt"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(path)
    (tmp_path / "empty").mkdir()
    (tmp_path / "link").symlink_to("a")
    return tmp_path


def test_scan_lists_folders_links_and_empty_ones(spark, tree):
    rows = numbered(files.scan_files(spark, str(tree), ("*.tmp", "/d/")), M.parents_first()).collect()
    got = [(r.path, r.kind, r.size) for r in sorted(rows, key=lambda r: r.nth)]
    want = [("a", "dir", None), ("a/b", "dir", None), ("a/b/kept.txt", "file", 12), ("a/b/two.txt", "file", 11), ("a/one.txt", "file", 9), ("c", "dir", None), ("empty", "dir", None), ("link", "symlink", None)]
    assert got == want  # parents first; what is ignored is not descended into, nor are links
    assert files.scan_files(spark, str(tree / "empty")).count() == 0


def test_a_folder_that_holds_anything_is_never_removed(spark, tree):
    plan = spark.createDataFrame([("a/b/two.txt", "file"), ("a/b", "dir"), ("a/one.txt", "file"), ("a", "dir"), ("c", "dir"), ("c/three.tmp", "file"), ("gone.txt", "file"), ("nowhere", "dir"), ("../outside.txt", "file"), ("empty", "file")], "path string, kind string")
    outside = tree.parent / "outside.txt"
    outside.write_text("x")
    done = {r.path: r.disposition for r in files.remove_files(plan, str(tree)).collect()}
    assert done == {"a/b/two.txt": "removed", "a/b": "kept", "a/one.txt": "removed", "a": "kept", "c": "removed", "c/three.tmp": "removed", "gone.txt": "already_absent", "nowhere": "already_absent", "../outside.txt": "failed", "empty": "failed"}
    assert (tree / "a/b/kept.txt").read_text() == "a/b/kept.txt" and outside.exists() and (tree / "empty").is_dir() and not (tree / "c").exists()
    again = {r.path: r.disposition for r in files.remove_files(plan, str(tree)).collect()}
    assert again["a/b"] == "kept" and again["c"] == "already_absent" and again["a/one.txt"] == "already_absent"


def test_a_file_that_comes_between_listing_and_removal_stays(tmp_path):
    """A store without an atomic rmdir is listed first; one new entry is enough to keep the folder."""
    from pyarrow import fs

    class Remote:
        """A store of another kind than the local one."""

        type_name = "other"

        def __init__(self):
            self.own = fs.LocalFileSystem()
            self.get_file_info, self.delete_dir = self.own.get_file_info, self.own.delete_dir

    (tmp_path / "x").mkdir()
    (tmp_path / "x/new.txt").write_text("n")
    assert files._remove_folder(Remote(), str(tmp_path / "x")) is False and (tmp_path / "x/new.txt").exists()
    os.remove(tmp_path / "x/new.txt")
    assert files._remove_folder(Remote(), str(tmp_path / "x")) is True and not (tmp_path / "x").exists()


def test_a_copy_that_fails_is_a_row(spark, tmp_path):
    (tmp_path / "taken").mkdir()

    def produce(data):
        if data == b"bad":
            raise RuntimeError("no")
        return data

    rows = spark.createDataFrame([("ok.txt", b"1", 1), ("bad.txt", b"bad", 3), ("short.txt", b"12", 3), ("taken", b"2", None), ("../up.txt", b"3", None), ("none.txt", None, None)], "dst string, content binary, size long")
    for _ in range(2):
        done = {r.dst: r.disposition for r in files.copy_files(rows, str(tmp_path), produce).collect()}
        assert done == {"ok.txt": "transferred", "bad.txt": "failed", "short.txt": "failed", "taken": "failed", "../up.txt": "failed", "none.txt": "transferred"}
        assert sorted(os.listdir(tmp_path)) == ["none.txt", "ok.txt", "taken"]  # nothing half written is left


def test_line_numbers_over_several_files(spark, tmp_path):
    for name, n in (("a", 5), ("b", 3)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(1, n + 1)))
    got = {(r.value, r.line) for r in records.line_numbers(spark.read.option("maxPartitionBytes", 8).text(str(tmp_path))).select("value", "line").collect()}
    assert got == {(f"{name}{i}", i) for name, n in (("a", 5), ("b", 3)) for i in range(1, n + 1)}


def test_manifest_round_trip_of_odd_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(b"a\xff/b"), "x/é", "file", 5), (bytearray(b"plain"), "../up", "file", 1)], "src binary, dst string, kind string, size long")
    refused = records.write_manifest(rows, str(tmp_path / "m"), ("size",)).collect()
    assert [(r.dst, r.error) for r in refused] == [("../up", "dot_component")]
    got = records.read_manifest(spark, str(tmp_path / "m")).collect()
    assert [(r.line, bytes(r.src), bytes(r.dst), r.kind, r.error) for r in got] == [(1, b"a\xff/b", "x/é".encode(), "file", None)]


def test_bad_results_end_a_stream(spark, tmp_path):
    (tmp_path / "r.ndjson").write_text('{"schema":"transfer.results","schema_version":1,"run":1,"seq":0,"type":"run"}\n{"schema":"transfer.results","schema_version":9,"run":1,"seq":1,"type":"result","status":"success"}\n')
    with pytest.raises(Exception, match="unknown_version"):
        logs.drained(logs.tail_results(spark, str(tmp_path)).select("run", "seq"), "bad")


def test_a_silent_run_is_closed_by_its_timer(spark, tmp_path):
    line = '{"schema":"transfer.results","schema_version":1,"run":%d,"seq":%d,"type":"%s"%s}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one").write_text(line % (1, 0, "run", "") + line % (2, 0, "run", "") + line % (2, 1, "result", ',"status":"success"'))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    seen = []
    stream = logs.run_completion(logs.tail_results(spark, str(tmp_path / "in")), silent_ms=1500)
    running = stream.writeStream.option("checkpointLocation", str(tmp_path / "log")).outputMode("update").trigger(processingTime="1 second").foreachBatch(lambda batch, _: seen.extend(map(tuple, batch.collect()))).start()
    try:
        end = time.time() + 60
        while time.time() < end and sum(x[4] for x in seen) < 2:
            time.sleep(0.5)
    finally:
        running.stop()
    assert {(1, 1, 0, "unknown", False), (2, 2, 0, "success", False), (1, 1, 0, "unknown", True), (2, 2, 0, "success", True)} == set(seen)


def test_a_rerun_converges(spark, sf):
    """The plan that was carried out leaves nothing to transfer."""
    t = Tables(spark, sf)
    src, dst = t.inv_src.filter("kind = 'file'"), t.inv_dst.filter("kind = 'file'")
    plan = reconcile.decide_files(reconcile.pairs(src, dst)).filter("action = 'transfer_file'").select("path")
    assert plan.count() > 0
    moved = src.join(plan, "path", "left_semi").withColumn("device", F.lit(2).cast("long"))
    after = dst.join(plan, "path", "left_anti").unionByName(moved)
    assert reconcile.decide_files(reconcile.pairs(src, after)).filter("action = 'transfer_file'").count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class C:
                        @staticmethod
                        def getCheckpointDir():
                            class O:
                                isDefined = staticmethod(lambda: False)

                            return O

                    return C

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_ties_and_times(spark):
    c = F.col
    rows = spark.createDataFrame([(1152,), (1280,), (1023,), (10 * 1024,), (10 * 1024 - 1,), (102349,), (1024**2 - 1,), (3 * 2**49,), (2**62,)], "n long")
    got = {r.n: r.h for r in rows.select("n", V.human_bytes(c("n")).alias("h")).collect()}

    def want(n):
        v, units, i = float(n), ("B", "KiB", "MiB", "GiB", "TiB", "PiB"), 0
        while v >= 1024 and i < 5:
            v, i = v / 1024, i + 1
        return f"{n} B" if not i else f"{v:.2f} {units[i]}" if v < 10 else f"{v:.1f} {units[i]}" if v < 100 else f"{v:.0f} {units[i]}"

    assert got == {n: want(n) for n in got} and got[1152] == "1.12 KiB"
    times = spark.createDataFrame([(10, 5, 2_000_000_007), (0, 0, -1), (-3, 999_999_999, 1)], "s long, n int, d long").select(V.add_duration(c("s"), c("n"), c("d")).alias("t"), V.ts_diff(c("s"), c("n"), F.lit(1), F.lit(1)).alias("x"))
    assert [(r.t.seconds, r.t.nanos, int(r.x)) for r in times.collect()] == [(12, 12, 9_000_000_004), (-1, 999_999_999, -1_000_000_001), (-2, 0, -3_000_000_002)]


def test_numbering_within_keys_is_by_ranges(spark):
    rows = spark.range(5000).select(F.when(c_ := F.col("id") % 3 == 0, "a").otherwise(F.when(F.col("id") % 100 == 1, None).otherwise("b")).alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    got = numbered(rows, ["v"], "nth", ["k"]).collect()
    for k in ("a", "b", None):
        own = sorted((r.v, r.nth) for r in got if r.k == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1)) and own
