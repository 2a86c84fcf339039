"""Mappings of sources to destinations, and constraints on a mapping as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktake.functions.paths import path_ancestors

from .prefixes import ancestors_of


def apply(mapping: DataFrame, src: DataFrame) -> DataFrame:
    """Each mapping row with its source: missing sources fail as not_found, wrong kinds as conflict, others go on."""
    found = mapping.join(src.select(F.col("path").alias("src"), F.col("kind").alias("found"), "size"), "src", "left")
    wrong = F.col("kind").isNotNull() & (F.col("kind") != F.col("found"))
    status = F.when(F.col("found").isNull(), "failed").when(wrong, "failed").otherwise("planned")
    return found.select("src", "dst", status.alias("status"), F.when(F.col("found").isNull(), "not_found").when(wrong, "conflict").alias("class"), "size")


def duplicate_destinations(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1")


def ancestor_conflicts(mapping: DataFrame) -> DataFrame:
    """dst rows below another dst that is declared as something other than a directory."""
    tops = mapping.filter(F.col("kind").isNull() | (F.col("kind") != "dir")).select(F.col("dst").alias("above")).distinct()
    down = mapping.select("dst", F.explode(path_ancestors(F.col("dst"))).alias("above"))
    return down.join(tops, "above").select("dst", "above").distinct()


def implicit_directories(mapping: DataFrame) -> DataFrame:
    """Ancestors of destinations that the mapping itself doesn't list as directories."""
    listed = mapping.filter("kind = 'dir'").select(F.col("dst").alias("path")).distinct()
    return ancestors_of(mapping.select(F.col("dst").alias("path"))).join(listed, "path", "left_anti")


def parents_first() -> list[Column]:
    """Parents before children: components compare one by one."""
    return [F.split("path", "/")]


def retry_manifest(results: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapping rows whose last outcome failed and may be tried again, of runs that ended as success or partial."""
    ended = results.filter("type = 'result' and status in ('success', 'partial')").select("run").distinct()
    failed = results.filter("disposition = 'failed' and coalesce(retryable, '') != 'no'").join(ended, "run", "left_semi").select("run", "dst").distinct()
    return failed.join(mapping, "dst")


def claim_resolution(claims: DataFrame) -> DataFrame:
    """One outcome for each dst of claims(dst, claim in dir, file, weak): directories merge, weak ones yield, two files contest, mixed kinds refuse."""
    n = lambda kind: F.count_if(F.col("claim") == kind)
    of = claims.groupBy("dst").agg(n("dir").alias("dirs"), n("file").alias("files"))
    out = F.when((F.col("dirs") > 0) & (F.col("files") > 0), "refused").when(F.col("files") > 1, "contested").when(F.col("files") == 1, "file").when(F.col("dirs") > 0, "dir").otherwise("weak")
    return of.select("dst", out.alias("outcome"))


def first_claims(selectors: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of selectors that repeat, the first stays."""
    return selectors.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")


def merged_attributes(claims: DataFrame, attributes: list[str], order: str) -> DataFrame:
    """For each dst and attribute, what the last source that sets it says."""
    return claims.groupBy("dst").agg(*(F.max_by(a, F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes))
