"""Which destination entries may go: not claimed, not above a claim, not protected, no alias of a claimed file, all or none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions.paths import path_ancestors, path_depth, path_parent

from .ordering import numbered
from .prefixes import ancestors_of, outside
from .selection import without_ignored


def candidates(dst: DataFrame, claims: DataFrame) -> DataFrame:
    """Destination rows that no claim(path) names."""
    return dst.join(claims.select("path").distinct(), "path", "left_anti")


def extras(dst: DataFrame, claims: DataFrame, rules: Sequence[str], delete_excluded: bool = False) -> DataFrame:
    """Candidates under ignore rules: what they ignore is kept, unless delete_excluded makes it an ordinary extra."""
    of = candidates(dst, claims)
    return of if delete_excluded else without_ignored(of, rules)


def without_claim_ancestors(of: DataFrame, claims: DataFrame) -> DataFrame:
    """A directory above any claim is kept."""
    return of.join(ancestors_of(claims), "path", "left_anti")


def unshielded(of: DataFrame, protected: DataFrame) -> DataFrame:
    """Nothing at or below a protected(path) goes."""
    return outside(of, protected)


def without_aliases(of: DataFrame, claimed: DataFrame) -> DataFrame:
    """Another name of a claimed file (device, inode) is kept, and so is what stands above it."""
    alias = of.join(claimed.select("device", "inode").distinct(), ["device", "inode"], "left_semi").select("path")
    return of.join(alias, "path", "left_anti").join(ancestors_of(alias), "path", "left_anti")


def kept_directories(dirs: DataFrame, kept: DataFrame) -> DataFrame:
    """path and the least reason of directories that hold a kept(path, reason)."""
    above = kept.select(F.explode(path_ancestors(F.col("path"))).alias("path"), "reason").distinct()
    return dirs.select("path").join(above, "path").groupBy("path").agg(F.min("reason").alias("reason"))


def delete_cap(plan: DataFrame, most: int) -> DataFrame:
    """disposition of planned deletions: if there are more than `most`, all are blocked. The count is one row."""
    count = plan.agg(F.count("*").alias("__n"))
    return plan.crossJoin(F.broadcast(count)).withColumn("disposition", F.when(F.col("__n") > most, "blocked").otherwise("planned")).drop("__n")


def prune_gate(plan: DataFrame, errors: DataFrame) -> DataFrame:
    """No deletion is left if there is any error. The count is one row."""
    count = errors.agg(F.count("*").alias("__n"))
    return plan.crossJoin(F.broadcast(count)).filter("__n = 0").drop("__n")


def gated(plan: DataFrame, errors: DataFrame) -> DataFrame:
    """disposition of planned deletions: any error blocks all of them. The count is one row."""
    count = errors.agg(F.count("*").alias("__n"))
    return plan.crossJoin(F.broadcast(count)).withColumn("disposition", F.when(F.col("__n") > 0, "blocked").otherwise("planned")).drop("__n")


def around_copy(before: DataFrame, after: DataFrame, scan_errors: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """phase of deletions before and after the copy: the first wait for a scan without errors, the others for a copy without any, by key."""
    first = prune_gate_by(before, scan_errors, key).withColumn("phase", F.lit("before"))
    return first.unionByName(prune_gate_by(after, errors, key).withColumn("phase", F.lit("after")))


def prune_gate_by(plan: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """No deletion is left of a `key` that has any error; a plan of other keys, or without one, is not stopped."""
    return plan.join(errors.select(key).distinct(), key, "left_anti")


def deletion_order() -> list[Column]:
    """Leaves first, then directories from the deepest."""
    return [F.col("kind") == "dir", F.desc(path_depth(F.col("path"))), F.col("path")]


def spread_by_parent(plan: DataFrame, group: int = 64) -> DataFrame:
    """turn: siblings go in groups, so that folders take turns."""
    placed = numbered(plan.withColumn("__parent", path_parent(F.col("path"))), ["path"], "__n", ["__parent"])
    return placed.withColumn("turn", F.floor((F.col("__n") - 1) / group).cast("int")).drop("__parent", "__n")


def request_batches(plan: DataFrame, by: str, size: int = 1000) -> DataFrame:
    """batch: rows of one `by` in batches of fixed size."""
    return numbered(plan, ["path"], "__n", [by]).withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")
