"""Prefix conditions by order: with `/` before all other characters, whatever is below a path stands right behind it.

So rows and roots are sorted together, in ranges, and what is open at a row is carried along; no row is
multiplied by its depth, and a root above nearly all rows is no hot key. Only the roots themselves are looked up by their ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions.paths import path_ancestors

from .ordering import running


def at_or_above(df: DataFrame, path: str = "path") -> DataFrame:
    """A row for the path itself and for each ancestor, in column at."""
    return df.withColumn("at", F.explode(F.array_append(path_ancestors(F.col(path)), F.col(path))))


def ancestors_of(df: DataFrame, path: str = "path") -> DataFrame:
    """Distinct strict ancestors of the paths, as path."""
    return df.select(F.explode(path_ancestors(F.col(path))).alias("path")).distinct()


def component_key(path: Column) -> Column:
    """A key in whose order whatever is below a path follows it at once."""
    return F.replace(path, F.lit("/"), F.lit("\0"))


def _beyond(path: Column) -> Column:
    """The first key that is not below the path any more."""
    return F.concat(component_key(path), F.lit("\1"))


def _met(df: DataFrame, events: DataFrame, how: str) -> DataFrame:
    """df with __met: what the events (__key, __rank, __value) up to each row's path come to. Rows come after events of the same key."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    kind = df.select(row.alias("r")).schema["r"].dataType
    rows = df.select(component_key(F.col("path")).alias("__key"), F.lit(2).alias("__rank"), F.lit(None).cast("string").alias("__value"), row.alias("__row"), F.lit(True).alias("__is_row"))
    both = rows.unionByName(events.select("__key", "__rank", "__value", F.lit(None).cast(kind).alias("__row"), F.lit(False).alias("__is_row")))
    found = running(both, ["__key", "__rank"], F.col("__value"), "__met", how=how)
    return found.filter("__is_row").select(*(F.col("__row").getField(c).alias(c) for c in df.columns), "__met")


def _inside(df: DataFrame, roots: DataFrame) -> DataFrame:
    """df with __in: whether the path is at or below a root. Roots are nested or apart, so the furthest end so far tells."""
    events = roots.select("path").distinct().filter("path is not null").select(component_key(F.col("path")).alias("__key"), F.lit(1).alias("__rank"), _beyond(F.col("path")).alias("__value"))
    return _met(df, events, "max").withColumn("__in", F.coalesce(F.col("__met") > component_key(F.col("path")), F.lit(False))).drop("__met")


def beneath(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows at or below a root(path), one for each path."""
    return _inside(df, roots).filter("__in").drop("__in").dropDuplicates(["path"])


def outside(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows neither at nor below a root(path); a null path is below none."""
    return _inside(df, roots).filter("not __in").drop("__in")


def scope_of(df: DataFrame, scopes: DataFrame) -> DataFrame:
    """path and its longest matching scope(path), null without one.

    A scope opens at its own key, and where it ends the one around it holds again; the last of these events before a row tells its scope.
    """
    own = scopes.select(F.col("path").alias("scope")).distinct().filter("scope is not null")
    above = own.withColumn("at", F.explode(path_ancestors(F.col("scope")))).join(own.select(F.col("scope").alias("around")), F.col("at") == F.col("around"))
    around = above.groupBy(F.col("scope").alias("of")).agg(F.max_by("around", F.length("around")).alias("around"))
    opened = own.select(component_key(F.col("scope")).alias("__key"), F.lit(1).alias("__rank"), F.col("scope").alias("__value"))
    # '' says that no scope is left: no path is empty
    closed = own.join(around, F.col("scope") == F.col("of"), "left").select(_beyond(F.col("scope")).alias("__key"), F.lit(0).alias("__rank"), F.coalesce("around", F.lit("")).alias("__value"))
    return _met(df.select("path"), opened.unionByName(closed), "last").select("path", F.nullif("__met", F.lit("")).alias("scope"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a, b) of paths where one is the other or contains it.

    Each path meets its longest match on the other side, and that one's own matches above it: no more rows than pairs.
    """
    paths = lambda df: df.select("path").distinct().filter("path is not null")

    def under(low: DataFrame, high: DataFrame) -> DataFrame:
        """(low, high): each path of low with the paths of high at or above it."""
        chain = at_or_above(high).join(high.select(F.col("path").alias("__up")), F.col("at") == F.col("__up")).select(F.col("path").alias("__of"), F.col("at").alias("high"))
        return scope_of(low, high).filter("scope is not null").join(chain, F.col("scope") == F.col("__of")).select(F.col("path").alias("low"), "high")

    a, b = paths(a), paths(b)
    down = under(a, b).select(F.col("low").alias("a"), F.col("high").alias("b"))
    return down.union(under(b, a).select(F.col("high").alias("a"), F.col("low").alias("b"))).distinct()
