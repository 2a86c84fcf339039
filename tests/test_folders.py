"""Scans that go on: what cannot be listed is a warning, its siblings are listed, and the gate closes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stocktake.functions.ignore import ignored, matcher
from stocktake.operators import prune
from stocktake.sources import files, folders


@pytest.fixture
def deep(tmp_path):
    """A tree with one folder whose path is too long to be opened by name, which no right can help."""
    for path in ("a/one.txt", "a/b/two.txt", "c/three.tmp", "c/keep.txt", "d/e/four.txt"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(path)
    here = os.getcwd()
    os.chdir(tmp_path / "d")
    depth = 0
    try:
        while len(os.fsencode(str(tmp_path))) + 2 + depth * 201 < 4200:
            os.mkdir("x" * 200)
            os.chdir("x" * 200)
            depth += 1
        open("hidden.txt", "w").close()
    finally:
        os.chdir(here)
    return tmp_path


def entries(df):
    return {r.path: (r.kind, r.size) for r in df.collect() if r.warning is None and "x" * 200 not in r.path}


WANT = {"a": ("dir", None), "a/one.txt": ("file", 9), "a/b": ("dir", None), "a/b/two.txt": ("file", 11), "c": ("dir", None), "c/keep.txt": ("file", 10), "d": ("dir", None), "d/e": ("dir", None), "d/e/four.txt": ("file", 12)}


@pytest.mark.parametrize("how", ["levels", "one job", "source"])
def test_a_folder_that_cannot_be_listed_is_a_warning(spark, deep, how):
    folders.register(spark)
    if how == "levels":
        found = files.scan_with_warnings(spark, str(deep), ("*.tmp",))
    else:
        found = spark.read.format("folders").option("root", str(deep)).option("ignore", "*.tmp").option("partitions", 1 if how == "one job" else 4).load()
    found = spark.createDataFrame(found.collect(), found.schema)
    assert entries(found) == WANT
    warnings = found.filter("warning is not null").collect()
    assert warnings and all("x" * 200 in r.path and r.kind is None and ("cannot list" in r.warning or "cannot stat" in r.warning) for r in warnings)
    plan = spark.createDataFrame([("gone.txt",)], "path string")
    assert {r.disposition for r in prune.gated(plan, found.filter("warning is not null")).collect()} == {"blocked"}
    assert {r.disposition for r in prune.gated(plan, found.filter("warning is not null and path like 'a/%'")).collect()} == {"planned"}
    assert files.scan_files(spark, str(deep)).columns == ["path", "kind", "size", "mtime_s", "mtime_ns"] if how == "levels" else True


def test_prefixes_are_pushed_to_the_reader(spark, deep, monkeypatch):
    folders.register(spark)
    read = lambda **o: entries(spark.read.format("folders").options(root=str(deep), **o).load())
    assert read(prefixes="a/b\nd/e/four.txt") == {k: v for k, v in WANT.items() if k in ("a/b", "a/b/two.txt", "d/e/four.txt")}
    opened = []
    listed = folders._entries
    monkeypatch.setattr(folders, "_entries", lambda store, base, folder: opened.append(folder) or listed(store, base, folder))
    reader = folders.FolderReader({"root": str(deep), "prefixes": "a/b", "partitions": "9"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[0] for r in rows) == ["a/b", "a/b/two.txt"] and set(opened) == {"", "a", "a/b"}


def test_a_root_that_is_not_there(spark, tmp_path):
    folders.register(spark)
    for scan in (lambda: files.scan_with_warnings(spark, str(tmp_path / "no")), lambda: spark.read.format("folders").option("root", str(tmp_path / "no")).load().collect()):
        with pytest.raises(Exception, match="cannot list"):
            scan()
    assert spark.read.format("folders").option("root", str(tmp_path)).load().count() == 0


def test_matcher_is_the_column(spark):
    r = random.Random(3)
    rules = ["*.tmp", "/a/", "b/*c", "!b/xc", "d/**/e/", "**/f", "g/**", "h[0-9]?", "\\!k", "# no", "!a/keep", "é*"]
    names = ["a", "b", "c", "d", "e", "f", "g", "h1z", "x.tmp", "xc", "!k", "keep", "éa", "z"]
    paths = sorted({("/".join(r.choice(names) for _ in range(r.randint(1, 4))), r.random() < 0.5) for _ in range(400)})
    for k in range(1, len(rules) + 1):
        ignores = matcher(rules[:k])
        want = {(p, d): ignores(p, d) or any(ignores("/".join(p.split("/")[:i]), True) for i in range(1, p.count("/") + 1)) for p, d in paths}
        if k in (1, 4, 9, len(rules)):
            got = spark.createDataFrame(paths, "path string, d boolean").select("path", "d", ignored(F.col("path"), F.col("d"), rules[:k]).alias("i"))
            assert {(x.path, x.d): x.i for x in got.collect()} == want
