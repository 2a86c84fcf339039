"""Comparing a source inventory with a destination inventory: one action and one reason for each entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions.values import mtime_matches

from .content import identified
from .prefixes import at_or_above

POLICIES = ("update", "update-if-older", "keep", "error", "error-if-different")


def pairs(src: DataFrame, dst: DataFrame, on: str = "path") -> DataFrame:
    """Each source with the destination at its path, as structs src and dst; null where absent."""
    pack = lambda df, name: df.select(F.col(on).alias(f"__{name}"), F.struct(*df.columns).alias(name))
    joined = pack(src, "src").join(pack(dst, "dst"), F.col("__src") == F.col("__dst"), "full_outer")
    return joined.select(F.coalesce("__src", "__dst").alias("path"), "src", "dst")


def same_file(same_host: bool = True) -> Column:
    """One device and inode on both sides; such numbers mean nothing across hosts."""
    if not same_host:
        return F.lit(False)
    return F.coalesce((F.col("src.device") == F.col("dst.device")) & (F.col("src.inode") == F.col("dst.inode")), F.lit(False))


def quick_unchanged() -> Column:
    """Both regular, of one size, and of matching times."""
    times = mtime_matches(F.col("src.mtime_s"), F.col("src.mtime_ns"), F.col("dst.mtime_s"), F.col("dst.mtime_ns"))
    return F.coalesce((F.col("src.kind") == "file") & (F.col("dst.kind") == "file") & (F.col("src.size") == F.col("dst.size")) & times, F.lit(False))


def hash_unchanged() -> Column:
    """Equal sizes and digests; a difference in size decides alone."""
    return F.coalesce((F.col("src.kind") == "file") & (F.col("dst.kind") == "file") & (F.col("src.size") == F.col("dst.size")) & (F.col("src.hash") == F.col("dst.hash")), F.lit(False))


def changed_attributes(selected: Sequence[str] = ("mode", "uid", "gid", "mtime")) -> Column:
    """Names of the selected attributes that differ; null on both sides is equal."""
    tests = {"mode": ["mode"], "uid": ["uid"], "gid": ["gid"], "mtime": ["mtime_s", "mtime_ns"]}
    differs = lambda a: ~F.forall(F.array(*(F.col(f"src.{x}").eqNullSafe(F.col(f"dst.{x}")) for x in tests[a])), lambda x: x)
    return F.array_compact(F.array(*(F.when(differs(a), F.lit(a)) for a in selected)))


def trace_reason(changed: Column) -> Column:
    return (
        F.when(F.col("src").isNull(), "destination_only")
        .when(F.col("dst").isNull(), "destination_missing")
        .when(F.col("src.kind") != F.col("dst.kind"), "type_differs")
        .when(changed, "content_differs")
        .otherwise("metadata_differs")
    )


def decide_files(of: DataFrame, policy: str = "update", unchanged: Column | None = None, attributes: Sequence[str] = ("mode",), low: int | None = None, high: int | None = None, permitted: Column | None = None, same_host: bool = True, contested: Column | None = None) -> DataFrame:
    """path, action, disposition and reason of pairs whose source is a regular file, and of destination-only rows.

    Tests go in this order: permission, same file, several sources for one destination (contested), size range and existence, a directory in the place,
    error policies, newer destination, unchanged contents, attributes alone, transfer.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    src, dst = F.col("src"), F.col("dst")
    exists, size = dst.isNotNull(), F.col("src.size")
    same = quick_unchanged() if unchanged is None else unchanged
    newer = F.struct("dst.mtime_s", "dst.mtime_ns") > F.struct("src.mtime_s", "src.mtime_ns")
    outside = (size < low if low is not None else F.lit(False)) | (size > high if high is not None else F.lit(False))
    attrs = F.size(changed_attributes(attributes)) > 0
    out = lambda action, disposition, reason: F.struct(F.lit(action).alias("action"), F.lit(disposition).alias("disposition"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    decision = (
        F.when(src.isNull(), out("none", "extra", "destination_only"))
        .when(~(F.lit(True) if permitted is None else permitted), out("none", "excluded", "predicate"))
        .when(same_file(same_host) & F.lit(policy == "error"), out("none", "failed", "exists"))
        .when(same_file(same_host), out("none", "excluded", "same_file"))
        .when(F.lit(False) if contested is None else contested, out("none", "failed", "contested"))
        .when(outside, out("none", "excluded", "size"))
        .when(exists & F.lit(policy == "keep"), out("none", "excluded", "exists"))
        .when(F.col("dst.kind") == "dir", out("none", "failed", "directory_in_place"))
        .when(exists & F.lit(policy == "error"), out("none", "failed", "exists"))
        .when(exists & F.lit(policy == "error-if-different") & ((F.col("dst.kind") != "file") | (F.col("dst.size") != size)), out("none", "failed", "differs"))
        .when(exists & F.lit(policy == "update-if-older") & newer, out("none", "excluded", "newer"))
        .when(same & attrs, out("set_attributes", "unchanged", "metadata_differs"))
        .when(same, out("none", "unchanged", "equal"))
        .otherwise(out("transfer_file", "planned", trace_reason(F.lit(True))))
    )
    kept = of.filter(src.isNull() | (F.col("src.kind") == "file"))
    return kept.withColumn("decision", decision).select("path", "decision.*", F.when(F.col("decision.action") == "transfer_file", size).otherwise(0).alias("bytes"))


def decide_links(of: DataFrame, policy: str = "update") -> DataFrame:
    """path, action, reason for sources that are links or specials: equal targets (links), kinds and device numbers (rdev, of char and block devices) are unchanged."""
    same = (F.col("src.kind") == F.col("dst.kind")) & F.col("src.link_target").eqNullSafe(F.col("dst.link_target"))
    if all("rdev" in of.schema[side].dataType.names for side in ("src", "dst")):
        same = same & (~F.col("src.kind").isin("char", "block") | F.col("src.rdev").eqNullSafe(F.col("dst.rdev")))
    newer = F.struct("dst.mtime_s", "dst.mtime_ns") > F.struct("src.mtime_s", "src.mtime_ns")
    exists = F.col("dst").isNotNull()
    action = (
        F.when(F.col("dst.kind") == "dir", "refuse").when(exists & F.lit(policy == "keep"), "keep").when(exists & F.lit(policy == "error"), "refuse")
        .when(same, "unchanged").when(exists & F.lit(policy == "error-if-different"), "refuse").when(exists & F.lit(policy == "update-if-older") & newer, "keep")
        .when(F.col("src.kind") == "symlink", "create_link").otherwise("create_special")
    )
    return of.filter(F.col("src.kind").isNotNull() & ~F.col("src.kind").isin("file", "dir")).select("path", action.alias("action"), trace_reason(F.lit(True)).alias("reason"))


def placements(of: DataFrame, require: str = "any") -> DataFrame:
    """path, placement (new or existing) and error of the sources of pairs: a requirement of `new` or `existing` targets refuses the others."""
    if require not in ("new", "existing", "any"):
        raise ValueError(f"unknown requirement {require!r}")
    placement = F.when(F.col("dst").isNull(), "new").otherwise("existing")
    return of.filter("src is not null").select("path", placement.alias("placement"), F.when(F.lit(require != "any") & (placement != require), F.concat(F.lit("target_is_"), placement)).alias("error"))


def only_existing(of: DataFrame) -> DataFrame:
    """Pairs that have both sides: what is never created is left out."""
    return of.filter("src is not null and dst is not null")


def replaced_not_in_place(plan: DataFrame) -> DataFrame:
    """How many transfers replace something, by reason; reasons without any are left out."""
    return plan.filter("action = 'transfer_file' and reason != 'destination_missing'").groupBy("reason").agg(F.count("*").alias("n"))


def decide_directories(src_dirs: DataFrame, dst: DataFrame) -> DataFrame:
    """path, action of wanted directories: create, exists, conflict (another kind in the place), skipped (below a conflict)."""
    joined = src_dirs.select("path").distinct().join(dst.select("path", "kind"), "path", "left")
    first = joined.withColumn("action", F.when(F.col("kind").isNull(), "create").when(F.col("kind") == "dir", "exists").otherwise("conflict"))
    conflicts = first.filter("action = 'conflict'").select(F.col("path").alias("__c"))
    below = at_or_above(first.select("path")).filter("at != path").join(conflicts, F.col("at") == F.col("__c"), "left_semi").select("path").distinct().withColumn("__below", F.lit(True))
    return first.join(below, "path", "left").select("path", F.when(F.col("__below"), "skipped").otherwise(F.col("action")).alias("action"))


def directory_attributes(decided: DataFrame, predicate: Column) -> DataFrame:
    """path, action and attributes of decide_directories: a predicate that a directory fails leaves its own attributes alone, not its place or what is below."""
    own = F.col("action").isin("create", "exists") & F.coalesce(predicate, F.lit(False))
    return decided.select("path", "action", own.alias("attributes"))


def mapping_attributes(mapping: DataFrame, src: DataFrame) -> DataFrame:
    """Overrides (mode, mtime, and uid and gid where the mapping has them) replace the source's attributes.

    An explicit time switches the quick test off; a mode on a link is refused.
    """
    owners = [x for x in ("uid", "gid") if x in src.columns]
    own = [F.col(x).alias(f"src_{x}") for x in ("kind", "mode", *owners)]
    joined = mapping.join(src.select(F.col("path").alias("src"), *own, "mtime_s"), "src")
    owner = [(F.coalesce(x, f"src_{x}") if x in mapping.columns else F.col(f"src_{x}")).alias(x) for x in owners]
    return joined.select("dst", F.coalesce("mode", "src_mode").alias("mode"), *owner, F.coalesce("mtime", "mtime_s").alias("mtime_s"), F.col("mtime").isNull().alias("quick_allowed"), F.when((F.col("src_kind") == "symlink") & F.col("mode").isNotNull(), "mode_on_link").alias("error"))


def capacity(plan: DataFrame, free_bytes: int, free_inodes: int) -> DataFrame:
    """Bytes and inodes that a plan(device, inode, bytes) needs, each inode once, and whether they fit with 64 inodes to spare. A row without an identity is a file of its own."""
    shared = identified(plan)
    once = plan.filter(shared).groupBy("device", "inode").agg(F.max("bytes").alias("bytes")).select("bytes").unionAll(plan.filter(~shared).select(F.coalesce("bytes", F.lit(0)).alias("bytes")))
    need = once.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("inodes"))
    return need.withColumn("fits", (F.col("bytes") <= free_bytes) & (F.col("inodes") + 64 <= free_inodes))
