"""The Merkle manifest against a plain tree, and proofs that hold or fail."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stocktake.llm import merkle_manifest
from stocktake.llm.merkle_manifest import audited, folded, manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place int, tree string, digest string, row string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes, fanout):
    """Levels from nodes to one node, and for each node its siblings to the left and right, level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([h("".join(at[i : i + fanout])) for i in range(0, len(at), fanout)])
    steps = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            first = i // fanout * fanout
            path.append((level[first:i], level[i + 1 : first + fanout]))
            i //= fanout
        steps.append(path)
    return levels[-1][0], steps


def manifest_of(rows, fanout=16):
    parts = {}
    for r in rows:
        changed = r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        parts.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(*r[:5]), leaf_of(*r[:4], changed), r[0]))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {p: up([x[2] for x in sorted(parts[p])], fanout) for p in order}
    root, above = up([trees[p][0] for p in order], fanout)
    out = []
    for i, p in enumerate(order):
        for x, steps in zip(sorted(parts[p]), trees[p][1]):
            now, sides = x[3], ""
            for left, right in steps + above[i]:
                now, sides = h("".join([*left, now, *right])), sides + "".join(left + right)
            out.append((x[4], x[2], trees[p][0], root, h(sides), now, now == root))
    return sorted(map(repr, out))


def rows_of(sizes):
    rows, n = [], 0
    for source, size in sizes.items():
        for i in range(size):
            rows.append((n, source, "en" if i % 3 else None, i, f"Text {n} É ÄB" if i % 4 else None, 1, "t", "d", "r"))
            n += 1
    return rows


ODD = [(None, None, None, None, None, 1, "t", "d", "r"), (None, "", "", 0, "", 1, "t", "d", "r"), (7, "a", "en", 1, "Same", 1, "t", "d", "r"), (7, "a", "en", 1, "Same", 1, "t", "d", "r"), (7, "a", "en", 1, "Other", 1, "t", "d", "r"), (-3, "é", "de", 2, "LONG " * 5000, 1, "t", "d", "r")]


@pytest.mark.parametrize("rows", [rows_of({"s": 1}), rows_of({"s": 17, None: 1}), rows_of({f"s{i}": 1 + i % 3 for i in range(40)}), rows_of({"hot": 300, "b": 16, "": 5}), ODD], ids=["one", "run of one", "many parts", "hot part", "odd rows"])
def test_audit_against_a_plain_tree(spark, rows):
    got = audited(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(repr(tuple(r)) for r in got.collect()) == manifest_of([r[:5] for r in rows])


def test_no_rows(spark):
    assert audited(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("fanout", [2, 3])
def test_other_fanouts_lead_to_the_root(spark, fanout):
    rows = rows_of({"a": 11, "b": 2, "c": 1})
    docs = spark.createDataFrame(rows, SCHEMA)
    got = manifest(docs, fanout=fanout).withColumn("to", folded(F.col("leaf"), F.col("steps"))).collect()
    roots = {p: up([leaf_of(*r[:5]) for r in rows if r[1] == p], fanout)[0] for p in "abc"}
    assert {r.source: r.subroot for r in got} == roots and all(r.to == r.root == up([roots[p] for p in "abc"], fanout)[0] for r in got)


def test_any_change_is_seen(spark):
    rows = rows_of({"a": 20, "b": 3})
    whole = manifest(spark.createDataFrame(rows, SCHEMA)).first().root
    for i, c, v in ((0, 0, 99), (19, 1, None), (22, 4, "no")):
        changed = [tuple(v if (j, k) == (i, c) else x for k, x in enumerate(r)) for j, r in enumerate(rows)]
        assert manifest(spark.createDataFrame(changed, SCHEMA)).first().root != whole


def test_siblings(spark):
    at = lambda place, n, fanout: spark.range(1).select(merkle_manifest.siblings(F.lit(place).cast("long"), F.lit(n).cast("long"), fanout)).first()[0]
    assert at(6, 9, 2) == [7] and at(8, 9, 2) == [] and at(5, 7, 4) == [6, 4] and at(16, 17, 16) == []
