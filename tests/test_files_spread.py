"""Work on files is dealt to tasks however its rows come, and a task holds few entries of a folder at once."""

import os

from pyspark import TaskContext
from pyspark.sql import functions as F

from stocktake.sources import files


def test_files_of_one_partition_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(200, numPartitions=1).select(F.concat(F.lit("d"), (F.col("id") % 2).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("dst"), F.lit(b"x").alias("content"))
    done = files.copy_files(rows, str(tmp_path), lambda data: str(TaskContext.get().partitionId()).encode()).collect()
    assert len(done) == 200 and {r.disposition for r in done} == {"transferred"}
    assert len({(tmp_path / f"d{i % 2}" / str(i)).read_text() for i in range(200)}) > 4


def test_folders_and_removals_are_dealt_to_several_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f").write_bytes(b"x")
    found = files.scan_files(spark, str(tmp_path)).filter("kind = 'file'").select("path", "kind", F.input_file_name().alias("written")).collect()
    assert len(found) == 40 and len({r.written for r in found}) > 4
    plan = spark.createDataFrame([(r.path, "file") for r in found], "path string, kind string").coalesce(1)
    removed = files.remove_files(plan, str(tmp_path)).select("disposition", F.input_file_name().alias("written")).collect()
    assert len(removed) == 40 and {r.disposition for r in removed} == {"removed"} and len({r.written for r in removed}) > 4


def test_entries_are_looked_at_as_frames_are_taken(tmp_path):
    looked = []

    def entries():
        for i in range(25_000):
            looked.append(i)
            yield f"f{i}", "file", i, 1, 2, None

    frames = files._frames(entries())
    assert len(next(frames)) == len(looked) == files._ROWS
    assert files._ROWS + sum(map(len, frames)) == len(looked) == 25_000


def test_a_root_that_cannot_be_listed_is_an_error(spark, tmp_path):
    import pytest

    with pytest.raises(Exception, match="cannot list"):
        files.scan_files(spark, os.path.join(str(tmp_path), "gone")).collect()
