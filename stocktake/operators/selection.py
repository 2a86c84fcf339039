"""Selecting rows of an inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions import paths as P
from stocktake.functions.ignore import ignored
from stocktake.functions.tiers import Node, derive_tiers


def where(inventory: DataFrame, predicate: Column) -> DataFrame:
    """The predicate holds for entries other than directories; directories always pass."""
    return inventory.filter(F.when(F.col("kind") == "dir", True).otherwise(predicate))


def where_two_tier(listing: DataFrame, cheap: Column, attributes: DataFrame, full: Column, on: Sequence[str]) -> DataFrame:
    """cheap: a predicate of listing columns that is null where stored attributes are needed; only such rows are joined with them.

    full is a predicate of both. Directory markers pass.
    """
    tiered = listing.withColumn("__tier", F.when((F.col("kind") == "dir"), True).otherwise(cheap))
    known = tiered.filter("__tier").drop("__tier")
    open_ = tiered.filter("__tier is null").drop("__tier").join(attributes, list(on), "left").filter(full)
    return known.unionByName(open_.select(*known.columns))


def where_stored(listing: DataFrame, predicate: Node, attributes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a listing for which a predicate over listed and stored facts holds; directories pass.

    The predicate is given once. Rows that listed facts decide are never joined; the others meet the needed
    columns of attributes only, which has one row at most for each key; what it lacks is null.
    """
    tiers = derive_tiers(predicate, listing.columns)
    if not tiers.needed:
        return where(listing, tiers.full)
    return where_two_tier(listing, tiers.cheap, attributes.select(*on, *tiers.needed), tiers.full, on)


def copy_if(pairs: DataFrame, predicate: Column) -> DataFrame:
    """permitted: whether a pair of source and destination may be copied; a directory keeps its place, only its own attributes are left."""
    return pairs.withColumn("permitted", predicate)


def without_ignored(inventory: DataFrame, lines: Sequence[str]) -> DataFrame:
    return inventory.filter(~ignored(F.col("path"), F.col("kind") == "dir", lines))


def size_range(inventory: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """excluded: regular files outside the range; they stay as claims, so that pruning keeps their destination."""
    size = F.col("size")
    out = (size < low if low is not None else F.lit(False)) | (size > high if high is not None else F.lit(False))
    return inventory.withColumn("excluded", (F.col("kind") == "file") & out)


def files_from(inventory: DataFrame, listed: DataFrame, recursive: bool = False) -> DataFrame:
    """Only listed paths; with `recursive` also what stands below a listed directory. listed: path."""
    own = inventory.join(listed.select("path").distinct(), "path", "left_semi")
    if not recursive:
        return own
    roots = listed.select(F.col("path").alias("__root")).distinct()
    above = inventory.withColumn("__above", F.explode(P.path_ancestors(F.col("path"))))
    below = above.join(roots, F.col("__above") == F.col("__root"), "left_semi").drop("__above")
    return own.unionByName(below).dropDuplicates(["path"])


def selected_kinds(selectors: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, wanted, status (selected, missing, wrong_kind) of typed selectors(path, wanted); wanted null takes any kind."""
    found = selectors.join(inventory.select("path", "kind"), "path", "left")
    is_dir = F.col("kind") == "dir"
    wrong = F.when(F.col("wanted") == "dir", ~is_dir).when(F.col("wanted") == "file", is_dir).otherwise(False)
    return found.select("path", "wanted", F.when(F.col("kind").isNull(), "missing").when(wrong, "wrong_kind").otherwise("selected").alias("status"))


def selected_or_refused(selectors: DataFrame, inventory: DataFrame) -> DataFrame:
    """selected_kinds, and refused: one selector of the wrong kind refuses the whole run, a missing one does not. The count is one row."""
    of = selected_kinds(selectors, inventory)
    wrong = of.agg(F.count_if(F.col("status") == "wrong_kind").alias("__n"))
    return of.crossJoin(F.broadcast(wrong)).withColumn("refused", F.col("__n") > 0).drop("__n")


def partials(inventory: DataFrame, tool: str = P.TOOL) -> DataFrame:
    """Regular files with the names of resumable partials; recovery data is no partial."""
    path = F.col("path")
    return inventory.filter((F.col("kind") == "file") & (P.is_partial_name(path, tool) | P.is_object_partial_name(path, tool)) & ~P.is_recovery_name(path, tool))
