"""The threshold algorithm through top_k: lists are read, bounds stop queries, results stay exact."""

import numpy as np
import pytest

from stocktake.llm import threshold_topk


def brute(rows, ids, asked, k=5):
    of = dict(zip(ids, rows))
    want = set()
    for q in asked:
        best = sorted(((-int(of[q] @ v), i) for i, v in of.items() if i != q))[:k]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return want


@pytest.mark.parametrize("least", [1024, 200])
def test_bounds_stop_queries_where_vectors_have_direction(spark, least):
    r = np.random.default_rng(8)
    rows = np.floor(100 * r.normal(0, 1, (3000, 8)) * np.exp(2 * r.normal(0, 1, (3000, 1)))).astype(int)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, vector array<bigint>")
    queries = frame.filter("id % 50 = 0")
    got = {tuple(x) for x in threshold_topk.top_k(frame, queries, least=least).collect()}
    assert got == brute(rows, range(3000), range(0, 3000, 50))
    told = threshold_topk.search_report(frame, queries, least=least).first()
    assert told.read > 0 and told.stopped > 0.5 * told.read and told.scored < 0.6 * 60 * 3000 and told.searches <= 60 * max(1, 3000 // least) + 60 * 4


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_lists_are_read_on_the_given_tables(spark, folder):
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    vectors = rows.select(rows.vec_id.alias("id"), threshold_topk.scaled(rows.embedding).alias("vector"))
    told = threshold_topk.search_report(vectors, vectors.filter("id % 50 = 0")).first()
    # these vectors have little direction: no bound stops a query, but each one that can be served has read lists first
    assert told.read == told.searches > 0 and told.held > 0 and told.scored <= 1.2 * told.held


def test_small_and_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, vector array<bigint>")
    for rows in ([(0, [3, 4])], [(0, [3, 4]), (1, [3, 4])], [(i, [0, 0]) for i in range(9)], [(i, [i, -i, 7]) for i in range(30)], [(0, []), (1, [])]):
        got = {tuple(x) for x in threshold_topk.top_k(frame(rows), frame(rows), k=3).collect()}
        assert got == brute(np.array([v for _, v in rows], dtype=int).reshape(len(rows), -1), [i for i, _ in rows], [i for i, _ in rows], 3)
    assert threshold_topk.search_report(frame([]), frame([])).first().searches == 0
