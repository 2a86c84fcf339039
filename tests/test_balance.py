"""Balanced partitions: equal costs, siblings apart, one task each."""

import random

import pytest
from pyspark.sql import functions as F

from stocktake.operators import balance


def plan_of(spark, sizes, folders=7):
    return spark.createDataFrame([(f"d{i % folders}/f{i:05d}", s) for i, s in enumerate(sizes)], "path string, size long")


@pytest.mark.parametrize("sizes", [[5], [10**9] + [100] * 400, [0] * 300, [2**20 * (i % 50) ** 3 for i in range(500)], [None] * 20 + [7 << 30] * 9, [random.Random(4).paretovariate(0.7) * 10**5 // 1 for _ in range(800)]], ids=["one", "one large", "empty files", "cubes", "few large", "heavy tail"])
@pytest.mark.parametrize("n", [1, 4, 13])
def test_no_partition_is_far_above_the_mean(spark, sizes, n):
    sizes = [None if s is None else int(s) for s in sizes]
    rows = balance.balanced(plan_of(spark, sizes), n).collect()
    assert len(rows) == len(sizes) and {r.path for r in rows} == {f"d{i % 7}/f{i:05d}" for i in range(len(sizes))}
    cost = [0] * n
    for r in rows:
        cost[r.partition] += (r.size or 0) + balance.PER_FILE
    costs = sorted((s or 0) + balance.PER_FILE for s in sizes)
    mean = sum(costs) / n
    assert max(cost) <= mean + costs[-1]
    # a heavy row alone, or the mean and one light row
    assert max(cost) <= max(costs[-1], mean) + max([c for c in costs if c * n * 8 <= sum(costs)], default=costs[-1]) + costs[-1] * (n < len([c for c in costs if c * n * 8 > sum(costs)]))
    for p in range(n):
        turns = sorted((r.turn, r.size or 0) for r in rows if r.partition == p)
        assert [t for t, _ in turns] == list(range(1, len(turns) + 1)) and [s for _, s in turns] == sorted((s for _, s in turns), reverse=True)


def test_siblings_do_not_stand_together(spark):
    plan = spark.createDataFrame([(f"d{i // 100}/f{i % 100:03d}", 4096) for i in range(1600)], "path string, size long")
    rows = sorted(balance.balanced(plan, 4).collect(), key=lambda r: (r.partition, r.turn))
    together = sum(a.partition == b.partition and a.path.split("/")[0] == b.path.split("/")[0] for a, b in zip(rows, rows[1:]))
    assert together < 0.02 * len(rows)
    assert all(len({r.path.split("/")[0] for r in rows if r.partition == p and r.turn <= 16}) >= 12 for p in range(4))


def test_each_partition_is_one_task(spark):
    dealt = balance.balanced(plan_of(spark, range(300)), 5)
    tasks = balance.in_partitions(dealt, 5).withColumn("task", F.spark_partition_id()).collect()
    assert all(r.task == r.partition for r in tasks) and {r.task for r in tasks} == set(range(5))
    turns = {}
    for r in tasks:
        assert r.turn == turns.get(r.task, 0) + 1
        turns[r.task] = r.turn


def test_rows_of_one_path_and_none(spark):
    same = spark.createDataFrame([("a", 1, i) for i in range(40)], "path string, size long, offset long")
    rows = balance.balanced(same, 4, then=["offset"]).collect()
    assert sorted(r.offset for r in rows) == list(range(40)) and {r.partition for r in rows} == {0, 1, 2, 3}
    assert balance.balanced(same.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        balance.balanced(same, 0)


def test_room_below_a_level():
    r = random.Random(2)
    for _ in range(200):
        loads, rest = [r.randint(0, 50) for _ in range(r.randint(1, 8))], r.randint(0, 200)
        room = balance.room_below(loads, rest)
        level = max([x + y for x, y in zip(loads, room) if y], default=0)
        assert sum(room) >= rest and all(y == max(0, level - x) for x, y in zip(loads, room))
        assert sum(max(0, level - 1 - x) for x in loads) < rest or rest == 0
