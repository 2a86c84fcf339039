"""Containment by order against plain comparison, whatever the ranges."""

import random

import pytest
from pyspark.sql import functions as F

from stocktake.operators import prefixes

NAMES = ["a", "b", "a!b", "a\x01", "ab", "a b", "é", "0", "-", "日"]


def random_paths(seed, n):
    r = random.Random(seed)
    return sorted({"/".join(r.choice(NAMES) for _ in range(r.randint(1, 4))) for _ in range(n)})


def at_or_below(path, root):
    return path == root or path.startswith(f"{root}/")


def frame(spark, paths):
    return spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n long").repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_containment(spark, seed):
    rows, roots = random_paths(seed, 300), random.Random(seed).sample(random_paths(seed + 10, 60), 25)
    df, of = frame(spark, [*rows, rows[0]]), frame(spark, [*roots, roots[0]])
    inside = {p for p in rows if any(at_or_below(p, r) for r in roots)}
    assert sorted(r.path for r in prefixes.beneath(df, of).collect()) == sorted(inside)
    assert sorted(r.path for r in prefixes.outside(df, of).collect()) == sorted([p for p in [*rows, rows[0]] if p not in inside])
    assert prefixes.outside(df, of).columns == df.columns
    scope = {p: max((r for r in roots if at_or_below(p, r)), key=len, default=None) for p in rows}
    assert sorted((r.path, r.scope) for r in prefixes.scope_of(df, of).filter("scope is not null").collect()) == sorted((p, scope[p]) for p in [*rows, rows[0]] if scope[p])
    assert prefixes.scope_of(df, of).count() == len(rows) + 1
    want = sorted((p, r) for p in rows for r in set(roots) if at_or_below(p, r) or at_or_below(r, p))
    assert sorted(map(tuple, prefixes.overlap(df, of).collect())) == want


def test_one_root_above_all_rows_in_several_ranges(spark):
    rows = spark.range(5000).select(F.concat(F.lit("top/"), F.col("id") % 70, F.lit("/"), F.col("id")).alias("path"), F.col("id").alias("n"))
    roots = spark.createDataFrame([("top",), ("top/3",), ("other",)], "path string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        inside = prefixes._inside(rows, roots)
        assert inside.filter("__in").count() == 5000 and prefixes.outside(rows, roots).count() == 0
        parts = prefixes.scope_of(rows, roots).groupBy("scope").agg(F.count("*").alias("n")).collect()
        assert {r.scope: r.n for r in parts} == {"top": 5000 - 72, "top/3": 72}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_nothing_to_compare(spark):
    none, some = spark.createDataFrame([], "path string, n long"), frame(spark, ["a", "a/b"])
    assert prefixes.beneath(some, none).count() == 0 and prefixes.outside(some, none).count() == 2 and prefixes.outside(none, some).count() == 0
    assert [r.scope for r in prefixes.scope_of(some, none).collect()] == [None, None] and prefixes.overlap(some, none).count() == 0
