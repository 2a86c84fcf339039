"""Commits: one of several succeeds, failures leave what was there, batches count once."""

import threading

import pytest
from pyspark.sql import functions as F

from stocktake.sources import commits


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def values(spark, root, number=None):
    return sorted(r.v for r in commits.published(spark, root, number).collect())


def test_two_publishers_on_one_base(spark, tmp_path):
    root = str(tmp_path / "t")
    assert commits.head(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        commits.published(spark, root)
    assert commits.publish(spark, rows(spark, 1), root) == 1
    base = commits.head(spark, root)
    assert commits.publish(spark, rows(spark, 1, 2), root, base) == 2
    with pytest.raises(commits.Conflict):
        commits.publish(spark, rows(spark, 1, 3), root, base)
    assert values(spark, root) == [1, 2] and values(spark, root, 1) == [1]
    assert commits.publish(spark, rows(spark, 1, 2, 3), root, 2) == 3 and values(spark, root) == [1, 2, 3]


def test_both_have_written_before_either_commits(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    commits.publish(spark, rows(spark, 0), root)
    put, both, found = commits.put_if_absent, threading.Barrier(2), []

    def together(spark, path, text):
        both.wait(60)
        return put(spark, path, text)

    monkeypatch.setattr(commits, "put_if_absent", together)

    def run(v):
        try:
            found.append((v, commits.publish(spark, rows(spark, v), root, 1)))
        except commits.Conflict:
            found.append((v, None))

    threads = [threading.Thread(target=run, args=(v,)) for v in (7, 8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [v for v, n in found if n == 2]
    assert len(won) == 1 and len(found) == 2 and values(spark, root) == won
    assert len(commits.superseded(spark, root)) == 2  # version 1 and the refused one


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_failure_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "t")
    commits.publish(spark, rows(spark, 1), root)
    if step == "commit":
        def fail(*_):
            raise OSError("store is gone")

        monkeypatch.setattr(commits, "put_if_absent", fail)
        new = rows(spark, 2)
    else:
        new = rows(spark, 2).select(F.raise_error(F.lit("no")).cast("long").alias("v"))
    with pytest.raises(Exception, match="gone|no"):
        commits.publish(spark, new, root)
    monkeypatch.undo()
    assert commits.head(spark, root) == 1 and values(spark, root) == [1]
    assert commits.publish(spark, rows(spark, 3), root) == 2 and values(spark, root) == [3]


def test_a_name_is_put_once(spark, tmp_path):
    path, won = str(tmp_path / "c" / "x"), []
    threads = [threading.Thread(target=lambda i=i: won.append(commits.put_if_absent(spark, path, str(i)))) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won.count(True) == 1 and len(list((tmp_path / "c").iterdir())) <= 2  # the file, and its checksum


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    day = lambda *v: rows(spark, *v).withColumn("day", F.when(F.col("v") > 0, F.col("v") % 2))
    assert commits.append_once(day(1, 2, -1), root, "q", 0, ("day",)) and not commits.append_once(day(1, 2, -1), root, "q", 0, ("day",))

    def fail(*_):
        raise OSError("no")

    monkeypatch.setattr(commits, "put_if_absent", fail)
    with pytest.raises(OSError):
        commits.append_once(day(3), root, "q", 1, ("day",))  # written, not committed
    monkeypatch.undo()
    got = lambda: sorted((r.v, r.day) if r.day is not None else (r.v, -1) for r in commits.appended(spark, root).collect())
    assert got() == [(-1, -1), (1, 1), (2, 0)]
    assert commits.append_once(day(3), root, "q", 1, ("day",)) and commits.append_once(day(3), root, "other", 1, ("day",)) and commits.append_once(day(), root, "q", 2, ("day",))
    assert got() == [(-1, -1), (1, 1), (2, 0), (3, 1), (3, 1)]
    with pytest.raises(ValueError):
        commits.append_once(day(1), root, "a/b", 0)


def test_a_stream_that_is_run_again_appends_nothing(spark, tmp_path):
    rows(spark, *range(20)).write.parquet(f"{tmp_path}/in")
    for log in ("first", "second"):  # a lost checkpoint brings the same batches again
        stream = spark.readStream.schema("v long").parquet(f"{tmp_path}/in")
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/{log}").trigger(availableNow=True).foreachBatch(lambda b, n: commits.append_once(b, f"{tmp_path}/t", "s", n)).start().awaitTermination()
    assert commits.appended(spark, f"{tmp_path}/t").count() == 20
