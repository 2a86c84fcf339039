"""Row functions that are awaited: many at a time, in order, failures alone."""

import asyncio
import time

import pytest

from stocktake.operators.transform import Context, Mapping


def mapping(spark, n, parts=1):
    return Mapping(spark.range(n).selectExpr("concat('s', id) as src", "concat('d', id) as dst", "id").coalesce(parts), Context("base"))


def test_many_calls_at_a_time_in_order(spark):
    async def slow(row):
        await asyncio.sleep(0.02)
        return {**row, "dst": row["src"]}

    of = mapping(spark, 200)
    of.map_rows_async(slow).rows.limit(1).collect()  # workers are started
    began = time.perf_counter()
    got = of.map_rows_async(slow).rows.collect()
    assert time.perf_counter() - began < 2.5  # 4 s one by one
    assert [r.id for r in got] == list(range(200)) and all(r.dst == r.src and r.error is None for r in got)


@pytest.mark.parametrize("under_way", [1, 3, 500])
def test_no_more_than_that_under_way(spark, under_way):
    async def count(row):
        state = count.__dict__
        state["now"] = state.get("now", 0) + 1
        state["most"] = max(state.get("most", 0), state["now"])
        await asyncio.sleep(0.001 * (row["id"] % 5))
        state["now"] -= 1
        return {**row, "dst": str(state["most"])}

    got = mapping(spark, 60).map_rows_async(count, under_way).rows.collect()
    assert [r.id for r in got] == list(range(60)) and 1 <= max(int(r.dst) for r in got) <= under_way
    assert under_way == 1 or max(int(r.dst) for r in got) > 1


def test_one_failure_is_one_row_and_none_omits(spark):
    def plain_or_awaited(row):
        if row["id"] == 4:
            raise KeyError("four")
        return asyncio.sleep(0, {**row, "src": None}) if row["id"] % 2 else None if row["id"] % 3 == 0 else row

    got = mapping(spark, 10).map_rows_async(plain_or_awaited).rows.collect()
    assert [(r.id, r.src, r.error) for r in got] == [(1, None, None), (2, "s2", None), (3, None, None), (4, "s4", "KeyError: 'four'"), (5, None, None), (7, None, None), (8, "s8", None), (9, None, None)]
    with pytest.raises(ValueError):
        mapping(spark, 1).map_rows_async(plain_or_awaited, error="src")
    assert mapping(spark, 0).map_rows_async(plain_or_awaited).rows.count() == 0
