"""Ignore rules as a table: thousands of them, from several folders.

An index by folder and by the part that a rule spells out is joined with what entries have, so an entry meets only the
rules that can match it. Rules are tested on rows and on the distinct folders above them; what stands below an ignored folder goes by order (prefixes).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.functions.ignore import compile_rule, rule_key
from stocktake.functions.paths import path_ancestors, path_name

from .prefixes import ancestors_of, outside

#: Folders with rules up to this number are named in the plan, so that an entry looks up no others.
NAMED_FOLDERS = 1000


def rule_index(rules: DataFrame) -> DataFrame:
    """folder, kind and literal to look up, ordinal, regex, ignores and only_folders for each rule of rules(folder, ordinal, line). Blank lines and comments are none; a null folder is the root, ''."""

    def compiled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for folder, ordinal, line in zip(f["folder"], f["ordinal"], f["line"]):
                if line and (rule := compile_rule(line)):
                    rows.append((folder, *rule_key(line), ordinal, rule.regex, not rule.keep, rule.folders))
            yield pd.DataFrame(rows, columns=["folder", "kind", "literal", "ordinal", "regex", "ignores", "only_folders"])

    given = rules.select(F.coalesce("folder", F.lit("")).alias("folder"), F.col("ordinal").cast("long").alias("ordinal"), "line")
    return given.mapInPandas(compiled, "folder string, kind string, literal string, ordinal long, regex string, ignores boolean, only_folders boolean")


def last_matches(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """path, is_folder and ignored of the entries(path, is_folder) that any rule matches: the one of the greatest ordinal decides. Entries of one path and kind are one."""
    index = rule_index(rules)
    folders = [r.folder for r in index.select("folder").distinct().limit(NAMED_FOLDERS + 1).collect()]
    if not folders:
        return entries.select("path", "is_folder", F.lit(False).alias("ignored")).limit(0)
    path, folder = F.col("path"), F.col("__folder")
    above = F.array_append(path_ancestors(path), F.lit(""))
    if len(folders) <= NAMED_FOLDERS:
        above = F.array_intersect(above, F.array(*map(F.lit, folders)))
    inner = F.when(folder == "", path).otherwise(F.substring(path, F.length(folder) + 2, F.length(path)))
    name = path_name(path)
    keys = {"name": name, "ext": F.regexp_extract(name, r"\.[^.]*\z", 0), "first": F.substring_index("__inner", "/", 1), "any": F.lit("")}
    looked = entries.select("path", "is_folder").distinct().withColumn("__folder", F.explode(above)).withColumn("__inner", inner)
    looked = looked.withColumn("__key", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("literal")) for k, v in keys.items()))))
    same = (folder == F.col("folder")) & (F.col("__key.kind") == F.col("kind")) & (F.col("__key.literal") == F.col("literal"))
    met = looked.join(index, same).filter((F.col("is_folder") | ~F.col("only_folders")) & F.rlike("__inner", F.col("regex")))
    return met.groupBy("path", "is_folder").agg(F.max_by("ignores", "ordinal").alias("ignored"))


def without_ignored(inventory: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of inventory(path, kind, ...) that rules(folder, ordinal, line) leave: the last rule that matches decides, and what an ignored folder holds cannot be reopened.

    Lines are those of ignore files; a rule sees paths below its folder only, relative to it. Ordinals order all
    rules of all folders and differ. A null path is kept.
    """
    is_folder = F.coalesce(F.col("kind") == "dir", F.lit(False))
    own = inventory.filter("path is not null").select("path", is_folder.alias("is_folder"))
    entries = own.unionByName(ancestors_of(own).withColumn("is_folder", F.lit(True)))
    gone = last_matches(entries, rules).filter("ignored")
    left = outside(inventory.withColumn("__is_folder", is_folder), gone.filter("is_folder").select("path"))
    files = gone.filter("not is_folder").select(F.col("path").alias("__gone"))
    return left.join(files, (F.col("path") == F.col("__gone")) & ~F.col("__is_folder"), "left_anti").drop("__is_folder")
