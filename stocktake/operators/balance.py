"""Copy work dealt to partitions of nearly equal cost, largest first, siblings apart."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered, running_total

#: What opening, creating and moving one file costs, in bytes of copying.
PER_FILE = 64 << 10
#: Rows of more than one in so many parts of a partition's mean are dealt one by one; there are at most as many for each partition.
_HEAVY = 8


def spread_key(place: Column) -> Column:
    """Places from 0 whose order interleaves distant ones: the bits in reverse, as text."""
    return F.reverse(F.lpad(F.bin(place), 44, "0"))


def least_loaded(costs: Sequence[int], n: int) -> tuple[list[int], list[int]]:
    """Each cost in the order given goes to the least loaded of n partitions, of equal ones the first: the partition of each, and all loads."""
    heap = [(0, i) for i in range(n)]
    chosen = []
    for cost in costs:
        load, i = heap[0]
        heapq.heapreplace(heap, (load + cost, i))
        chosen.append(i)
    return chosen, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def room_below(loads: Sequence[int], rest: int) -> list[int]:
    """The room of each partition below the lowest common level at which `rest` fits."""
    ordered, below = sorted(loads), 0
    level = 0
    for k, load in enumerate(ordered, 1):
        below += load
        level = -(-(rest + below) // k)
        if k == len(ordered) or level <= ordered[k]:
            break
    return [max(0, level - load) for load in loads]


def balanced(plan: DataFrame, n: int, path: str = "path", size: str = "size", per_file: int = PER_FILE, then: Sequence[str] = ()) -> DataFrame:
    """plan with partition (from 0 to n - 1) and turn (from 1 in its partition): all of about equal cost, size + per_file for each row.

    Heavy rows go one by one to the least loaded partition; there are at most 8 * n of them, whatever the
    plan's length. The others fill the room that is left, in the order of their reversed places by path, so neighbours
    in a folder are far apart and each partition gets sizes of all kinds. A partition is above the mean of all, or above its only
    heavy row, by less than one other row's cost. Within a partition the largest goes first; equal sizes take turns in the spread order. A null size
    counts as 0; rows of one path are told apart by the columns `then`; rows equal in all of them may change places. No rows give none.
    """
    if n < 1 or per_file < 1:
        raise ValueError("there is at least one partition, and a file costs something")
    cost = F.coalesce(F.col(size).cast("long"), F.lit(0)).cast("long") + F.lit(per_file).cast("long")
    placed = numbered(plan.withColumn("__cost", cost), [path, *then], "__place").withColumn("__key", spread_key(F.col("__place") - 1))
    total = placed.agg(F.coalesce(F.sum("__cost"), F.lit(0))).first()[0]
    heavy = F.col("__cost") * n * _HEAVY > F.lit(total).cast("decimal(38,0)")
    alone = placed.filter(heavy).select("__place", "__cost", "__key").toPandas().sort_values(["__cost", "__key"], ascending=[False, True], kind="stable")
    chosen, loads = least_loaded([int(x) for x in alone["__cost"]], n)
    rest = total - sum(loads)
    ends = np.cumsum(room_below(loads, rest)) if rest else np.zeros(n, np.int64)
    found = running_total(placed, ["__key"], F.when(~heavy, F.col("__cost")).otherwise(0), "__end")
    of = dict(zip(alone["__place"].tolist(), chosen))

    @F.pandas_udf("int")
    def partition(place: pd.Series, cost: pd.Series, end: pd.Series, is_heavy: pd.Series) -> pd.Series:
        filled = np.minimum(np.searchsorted(ends, (end - cost).to_numpy(), side="right"), n - 1)
        return pd.Series(np.where(is_heavy, [of.get(p, 0) for p in place], filled)).astype("int32")

    dealt = found.withColumn("partition", partition("__place", "__cost", "__end", heavy))
    ordered = running_total(dealt, [F.desc("__cost"), "__key"], F.lit(1).cast("long"), "turn", ["partition"])
    return ordered.select(*plan.columns, "partition", "turn")


def in_partitions(dealt: DataFrame, n: int) -> DataFrame:
    """Each partition of balanced() as one task, in its turns."""
    return dealt.repartitionById(n, F.col("partition")).sortWithinPartitions("turn")


def loads(dealt: DataFrame, size: str = "size", per_file: int = PER_FILE) -> DataFrame:
    """files and cost of each partition."""
    return dealt.groupBy("partition").agg(F.count("*").alias("files"), F.sum(F.coalesce(F.col(size).cast("long"), F.lit(0)) + per_file).alias("cost"))


