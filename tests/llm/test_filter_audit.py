"""The filter audit against plain counting, and its lists against sets."""

import random
from itertools import permutations

import numpy as np
import pytest

from stocktake.llm import filter_audit

SCHEMA = "doc_id long, source string, text string, part string, digest string, good string, A int, id string"
LONG = " ".join(f"word{i}" for i in range(60))


def fails(text, doc_id, smallest):
    words = text.encode().split()
    capitals = sum("A" <= c <= "Z" for c in text)
    return "".join(x for x, bad in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text), any(c in text for c in "#$%&*|"), doc_id is not None and doc_id > smallest.get(text, doc_id))) if bad)


def audit_of(rows, labels):
    smallest = {}
    for d, _, t in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    parts = {}
    for d, s, t in rows:
        parts.setdefault(s or "", []).append((set(fails(t or "", d, smallest)), d))
    out = []
    for part, found in parts.items():
        removed_in, steps = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = found
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                removed_in[f] += len(gone)
                steps.append((f, "".join(order), i + 1, len(left), len(gone), sum(f in x[0] for x in found) - len(gone), sum(x[0] == {f} for x in found), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)))
        out += [(part, *s[1:], removed_in[s[0]]) for s in steps]
    return sorted(out)


def odd_rows():
    r = random.Random(5)
    texts = [None, "", " \n\t", LONG, LONG, LONG + " # x", "SHOUT " * 60, "same " * 80, LONG.upper(), "é à" * 40, "a|b", LONG * 300, "x" * 30000]
    rows = [(i, r.choice(["s", "s", "s", "t", None, ""]), r.choice(texts)) for i in range(70)]
    return rows + [(None, "s", LONG), (None, None, None), (3, "s", LONG), (3, "s", LONG), (3, "t", "other"), (-5, "u", LONG)]


@pytest.mark.parametrize("span", [1, 7, 4096])
def test_audit_against_plain_counting(spark, span):
    rows = odd_rows()
    labels = [(i, i % 2, (i % 3 == 0) * 1) for i in range(0, 70, 2)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*x, "p", "d", "g", 1, "i") for x in rows], SCHEMA).repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), span)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == columns and sorted(map(tuple, got.collect())) == audit_of(rows, labels)


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), none).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "s", LONG)], "doc_id long, source string, text string"), none).collect()
    assert len(one) == 600 and all(r.kept == 1 and r.removed == r.good_lost == r.shapley == 0 for r in one)


def test_lists_against_sets():
    r = random.Random(1)
    for _ in range(300):
        a, b = (sorted(r.sample(range(n), r.randint(0, min(n, 600)))) for n in (r.choice([5, 700, 100000]), r.choice([5, 700, 100000])))
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        assert filter_audit.inside(x, y).tolist() == [v in set(b) for v in a]
        assert filter_audit.less(x, y).tolist() == sorted(set(a) - set(b))
        assert filter_audit.merged(y, filter_audit.less(x, y)).tolist() == sorted(set(a) | set(b))
        for at in (0, len(b) // 2):
            bound = r.randint(0, 1000)
            assert filter_audit.gallop(y, at, bound) == max([at, *(i + 1 for i in range(at, len(b)) if b[i] < bound)])
