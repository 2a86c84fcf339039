"""Global order without one task for all rows: ranges are sorted apart, and only their totals meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktake.sources.scratch import settle


def running(df: DataFrame, order: Sequence[Column | str], value: Column, out: str, keys: Sequence[str] = (), how: str = "sum") -> DataFrame:
    """out: the sum, the greatest or the last value (how: sum, max, last; nulls don't count) of this row and all before it in the order, of rows with the same keys.

    Ranges of keys and order are worked on apart, so a key that holds most rows is many tasks. There is one row for each range and
    key in the window over ranges. Where rows are equal in the order, either may come first.
    """
    over = {"sum": F.sum, "max": F.max, "last": lambda x: F.last(x, ignorenulls=True)}[how]
    wanted = [*keys, *order]
    ranged = df.withColumn("__v", value).repartitionByRange(*wanted).sortWithinPartitions(*wanted)
    parted = settle(ranged.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "order")
    own = over(F.col("__v")).over(Window.partitionBy("__p", *keys).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__i"))) if how == "last" else over(F.col("__v"))
    totals = parted.groupBy("__p", *keys).agg(whole.alias("__t"))
    earlier = over(F.col("__t")).over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select(F.col("__p").alias("__q"), *(F.col(k).alias(f"__of_{k}") for k in keys), earlier.alias("__b"))
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    met = {"sum": F.coalesce(F.col(out) + F.col("__b"), out, "__b"), "max": F.greatest(out, "__b"), "last": F.coalesce(out, "__b")}[how]
    return parted.withColumn(out, own).join(before, same).withColumn(out, met).select(*df.columns, out)


def running_total(df: DataFrame, order: Sequence[Column | str], value: Column, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """out: the sum of value over this row and all before it in the order, of rows with the same keys (running)."""
    return running(df, order, value, out, keys)


def numbered(df: DataFrame, order: Sequence[Column | str], out: str = "nth", keys: Sequence[str] = ()) -> DataFrame:
    """out: each row's place in the order, from 1, among rows with the same keys."""
    return running_total(df, order, F.lit(1).cast("long"), out, keys)
