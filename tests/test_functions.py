"""Table-driven cases of functions whose edges the derived tables do not reach."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stocktake.functions import ignore, paths, predicates, values


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("path, extension", [("a/.bashrc", ""), ("a/b.tar.gz", "gz"), ("a.b/c", ""), ("a/.x.y", "y"), ("a.", "")])
def test_extension(spark, path, extension):
    assert value(spark, paths.path_extension(F.lit(path))) == extension


@pytest.mark.parametrize("path, error", [("", "empty"), ("/a", "absolute"), ("a//b", "empty_component"), ("a/", "empty_component"), ("a/../b", "dot_component"), ("a/b", None), ("a\0b", "nul"), (None, "missing")])
def test_path_error(spark, path, error):
    assert value(spark, paths.path_error(F.lit(path).cast("string"))) == error


@pytest.mark.parametrize("text, rate", [("1", 1024), ("1.5m", 1572864), ("0", 0), ("511b", None), ("512b", 1024), ("1k+1", 1024), ("1000kb", 1000448), ("x", None)])
def test_rate(spark, text, rate):
    assert value(spark, values.parse_rate(F.lit(text))) == rate


@pytest.mark.parametrize("src, dst, same", [((1, 123456789), (1, 0), True), ((1, 123456789), (1, 123000000), True), ((1, 124000000), (1, 123000000), False), ((2, 0), (1, 0), False), ((1, 5), (1, 5), True)])
def test_mtime_precision(spark, src, dst, same):
    assert value(spark, values.mtime_matches(*(F.lit(x) for x in (*src, *dst)))) is same


@pytest.mark.parametrize(
    "lines, path, folder, gone",
    [
        (["*.o"], "a/b.o", False, True), (["/a"], "b/a", False, False), (["a/"], "a", False, False), (["a/"], "a/b", False, True), (["a/", "!a/b"], "a/b", False, True), (["*.o", "!b.o"], "a/b.o", False, False),
        (["a/**/z"], "a/z", False, True), (["a/**/z"], "a/b/c/z", False, True), (["a/*"], "a/b/c", False, True), (["#a"], "#a", False, False), (["\\#a"], "#a", False, True), (["a?c"], "a/c", False, False), (["[ab]c"], "x/bc", False, True), (["[!ab]c"], "bc", False, False),
    ],
)
def test_ignore(spark, lines, path, folder, gone):
    assert value(spark, ignore.ignored(F.lit(path), F.lit(folder), lines)) is gone


@pytest.mark.parametrize("pattern, key, hit", [("logs/*", "logs/a", True), ("logs/*", "logs/a/b", False), ("logs/**", "logs/a/b", True), ("lo?s", "logs", True), ("a.b", "axb", False), ("logs", "logs/", False)])
def test_key_pattern(spark, pattern, key, hit):
    assert value(spark, predicates.key_pattern(F.lit(key), pattern)) is hit


@pytest.mark.parametrize("column", [lambda: predicates.less(F.lit(None).cast("int"), F.lit(1)), lambda: predicates.divided(F.lit(1), F.lit(0)), lambda: predicates.matches(F.lit(None).cast("string"), "a")])
def test_misuse_fails(spark, column):
    with pytest.raises(PySparkException):
        value(spark, column())


def test_guard_protects(spark):
    assert value(spark, predicates.both(F.lit(False), predicates.divided(F.lit(1), F.lit(0)) > 1)) is False


def test_versions(spark):
    assert [value(spark, values.version_matches(F.lit(v), ">=1.2.0,<2.0.0|=3.0.0")) for v in ("1.2.0", "1.10.0", "2.0.0", "3.0.0")] == [True, True, False, True]
    with pytest.raises(ValueError):
        values.version_matches(F.lit("1.0.0"), ">=1.2")


def test_contexts_that_differ_are_refused(spark):
    from stocktake.operators.transform import Context, Mapping

    rows = spark.createDataFrame([("a", "b")], "src string, dst string")
    with pytest.raises(ValueError):
        Mapping(rows, Context("x")).union(Mapping(rows, Context("y")))
