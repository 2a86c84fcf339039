"""Both tiers of a predicate together are the predicate, on random trees; only what is open is joined."""

import random

import pytest
from pyspark.sql import functions as F

from stocktake.functions import tiers as N
from stocktake.operators import selection

KNOWN, STORED = ["a", "b"], ["x", "y"]
UNKNOWN = object()


def tree(r, depth, kind="bool"):
    if kind == "int":
        if depth == 0 or r.random() < 0.3:
            return N.fact(r.choice("abxy")) if r.random() < 0.8 else N.value(r.choice([0, 1, 2, None]))
        pick = r.random()
        if pick < 0.35:
            return N.first_of(*(tree(r, depth - 1, "int") for _ in range(r.randint(2, 3))))
        if pick < 0.7:
            return N.choose(tree(r, depth - 1), tree(r, depth - 1, "int"), tree(r, depth - 1, "int"))
        return N.call(lambda p, q: p + q, tree(r, depth - 1, "int"), tree(r, depth - 1, "int"))
    if depth == 0 or r.random() < 0.25:
        f = r.choice([N.equal, N.below])
        return N.absent(tree(r, 0, "int")) if r.random() < 0.2 else f(tree(r, max(depth - 1, 0), "int"), tree(r, 0, "int"))
    pick = r.random()
    sub = lambda: tree(r, depth - 1)
    return sub() & sub() if pick < 0.35 else sub() | sub() if pick < 0.65 else ~sub() if pick < 0.8 else N.choose(sub(), sub(), sub())


def plain(node, row):
    """The value by Python, or UNKNOWN where it cannot be told from the row's facts."""
    if node.op == "fact":
        return row.get(node.args[0], UNKNOWN)
    if node.op == "value":
        return node.args[0]
    v = [plain(x, row) for x in node.args]
    if node.op in ("all", "any"):
        end = node.op == "any"
        return end if any(x is end for x in v) else UNKNOWN if UNKNOWN in v else None if None in v else not end
    if node.op == "if":
        if v[0] is UNKNOWN:
            return v[1] if UNKNOWN not in v[1:] and v[1] == v[2] else UNKNOWN
        return v[1] if v[0] else v[2]
    if node.op == "first":
        for x in v:
            if x is not None:
                return x
        return None
    if UNKNOWN in v:
        return UNKNOWN
    if node.op == "not":
        return None if v[0] is None else not v[0]
    name = node.of.__qualname__
    if name.startswith("equal"):
        return v[0] == v[1]
    if name.startswith("absent"):
        return v[0] is None
    if None in v:
        return None
    return v[0] < v[1] if name.startswith("below") else v[0] + v[1]


@pytest.mark.parametrize("seed", range(6))
def test_tiers_of_random_trees(spark, seed):
    r = random.Random(seed)
    rows = [dict(zip("kabxy", (i, *(r.choice([None, 0, 1, 2]) for _ in range(4))))) for i in range(80)]
    all_ = spark.createDataFrame([tuple(x.values()) for x in rows], "k int, a int, b int, x int, y int")
    trees = [tree(r, 3) for _ in range(12)]
    found = [N.derive_tiers(t, KNOWN) for t in trees]
    got = all_.select("k", *(f.cheap.alias(f"cheap{i}") for i, f in enumerate(found)), *(f.full.alias(f"full{i}") for i, f in enumerate(found))).collect()
    for row in got:
        facts = rows[row.k]
        for i, t in enumerate(trees):
            whole, listed = plain(t, facts), plain(t, {k: facts[k] for k in KNOWN})
            assert row[f"full{i}"] == bool(whole)
            assert row[f"cheap{i}"] == (None if listed is UNKNOWN else bool(listed)), (facts, i)
            assert row[f"cheap{i}"] in (None, row[f"full{i}"])  # what the listing decides is what all facts say
        assert all(set(f.needed) == N.facts(t) - set(KNOWN) for f, t in zip(found, trees))


def test_only_open_rows_are_joined(spark):
    listing = spark.createDataFrame([("d", "dir", 1), ("a", "file", 1), ("b", "file", 50), ("c", "file", 99), ("e", "file", 60)], "path string, kind string, size int")
    stored = spark.createDataFrame([("b", "me", 1), ("e", "you", 2), ("a", "me", 3), ("d", "no", 4)], "path string, owner string, other int")
    predicate = N.below(80, N.fact("size")) | (N.below(10, N.fact("size")) & N.equal(N.fact("owner"), "me"))
    kept = selection.where_stored(listing, predicate, stored, ["path"])
    assert sorted(r.path for r in kept.collect()) == ["b", "c", "d"] and kept.columns == listing.columns
    assert sorted(r.path for r in N.undecided(listing, predicate).collect()) == ["b", "e"]
    cheap_only = selection.where_stored(listing, N.below(80, N.fact("size")), stored, ["path"])
    assert sorted(r.path for r in cheap_only.collect()) == ["c", "d"] and "Join" not in cheap_only._jdf.queryExecution().optimizedPlan().toString()
    assert N.derive_tiers(~N.fact("owner"), ["size"]).needed == ("owner",)
    assert kept.filter(F.col("kind") == "dir").count() == 1
