"""Objects of a store: listings, versions, stored attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions.checksums import CRC64NVME, combined, etag_of_parts
from stocktake.functions.paths import path_ancestors, path_relative

from .prefixes import beneath

# The headers that count as attributes.
HEADERS = ("content_type", "content_encoding", "content_language", "content_disposition", "cache_control", "expires", "website_redirect")


def children(listing: DataFrame, prefix: str) -> DataFrame:
    """Immediate objects and common prefixes below a prefix, with how many keys and bytes each holds."""
    rest = F.when(F.lit(prefix == ""), F.col("key")).otherwise(path_relative(F.col("key"), F.lit(prefix.rstrip("/"))))
    below = listing.withColumn("rest", rest).filter("rest is not null and rest != ''")
    name = F.when(F.contains("rest", F.lit("/")), F.concat(F.substring_index("rest", "/", 1), F.lit("/"))).otherwise(F.col("rest"))
    return below.groupBy("bucket", name.alias("name")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def versions_of(selectors: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions that selectors(path, tree, version) name: exact keys, or all keys below; one version if it is given, of a tree as well."""
    exact = versions.join(selectors.filter("not tree").select(F.col("path").alias("key"), F.col("version").alias("__v")), "key").filter("__v is null or __v = version").drop("__v")
    roots = selectors.filter("tree").select(F.col("path").alias("__root"), F.col("version").alias("__v")).distinct()
    above = versions.withColumn("__at", F.explode(F.concat(path_ancestors(F.col("key")), F.array("key"))))
    tree = above.join(roots, F.col("__at") == F.col("__root")).filter("__v is null or __v = version").select(*versions.columns)
    return exact.unionByName(tree).dropDuplicates(["key", "version"])


def with_phase(versions: DataFrame) -> DataFrame:
    """phase 0 removes data versions, phase 1 delete markers."""
    return versions.withColumn("phase", F.col("marker").cast("int"))


def markers_kept(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """Markers of a key stay if a data version of any key failed. The count is one row."""
    count = failed.agg(F.count("*").alias("__n"))
    return plan.crossJoin(F.broadcast(count)).filter("not marker or __n = 0").drop("__n")


def listed_state(keys: DataFrame, listing: DataFrame, covered: DataFrame) -> DataFrame:
    """present, absent, or unknown where no listed(path) prefix covers the key."""
    seen = keys.join(listing.select("key", F.lit(True).alias("__here")).distinct(), "key", "left")
    inside = beneath(keys.select(F.col("key").alias("path")).distinct(), covered).select(F.col("path").alias("key"), F.lit(True).alias("__covered"))
    state = F.when(F.col("__here"), "present").when(F.col("__covered"), "absent").otherwise("unknown")
    return seen.join(inside, "key", "left").select("key", state.alias("state"))


def same_contents(quick: Column) -> Column:
    """Whether objects src and dst hold the same contents: kind and size, then a stored hash of one algorithm, then
    full-object SHA-256, then CRC64NVME, then the ETag or the quick test."""
    s, d = (lambda c: F.col(f"src.{c}")), (lambda c: F.col(f"dst.{c}"))
    known = lambda c: s(c).isNotNull() & d(c).isNotNull()
    full = (s("checksum_type") == "FULL_OBJECT") & (d("checksum_type") == "FULL_OBJECT")
    return F.coalesce(
        F.when((s("kind") != d("kind")) | (s("size") != d("size")), False)
        .when(s("kind") == "dir", True)
        .when(known("hash") & (s("hash_algorithm") == d("hash_algorithm")), s("hash") == d("hash"))
        .when(full & known("sha256"), s("sha256") == d("sha256"))
        .when(full & known("crc64"), s("crc64") == d("crc64"))
        .otherwise((s("etag") == d("etag")) | quick),
        F.lit(False),
    )


def local_checksums(parts: DataFrame, on: str = "path") -> DataFrame:
    """checksum_type, crc64 and etag of whole local files from parts(on, block, left, crc64, md5), as a store reports them, so that same_contents can decide.

    crc64 of a part is a signed long, of the whole the base64 of its 8 bytes; left: the bytes that follow the part; md5 is hex. The etag is that of an
    object uploaded in these parts (a store takes 10,000 at most), or the MD5 of a single one.
    """
    digests = F.transform(F.sort_array(F.collect_list(F.struct("block", "md5"))), lambda x: x["md5"])
    found = parts.groupBy(on).agg(combined("crc64", "left", CRC64NVME).alias("crc"), digests.alias("digests"))
    crc64 = F.base64(F.unhex(F.lpad(F.hex("crc"), 16, "0")))
    etag = F.when(F.size("digests") == 1, F.col("digests")[0]).otherwise(etag_of_parts(F.col("digests")))
    return found.select(on, F.lit("FULL_OBJECT").alias("checksum_type"), crc64.alias("crc64"), etag.alias("etag"))


def same_attributes(headers: Sequence[str] = HEADERS) -> Column:
    """User metadata, headers, storage class (absent is STANDARD) and tags."""
    entries = lambda c: F.array_sort(F.map_entries(F.coalesce(F.col(c), F.expr("cast(map() as map<string,string>)"))))
    tests = [F.col(f"src.{h}").eqNullSafe(F.col(f"dst.{h}")) for h in headers]
    tests += [entries(f"src.{m}") == entries(f"dst.{m}") for m in ("user_metadata", "tags")]
    tests.append(F.coalesce("src.storage_class", F.lit("STANDARD")) == F.coalesce("dst.storage_class", F.lit("STANDARD")))
    return F.forall(F.array(*tests), lambda x: x)


def merged_headers(own: str, other: str, selected: Sequence[str], headers: Sequence[str] = HEADERS) -> list[Column]:
    """The headers of struct `own`, those selected replaced by what struct `other` has; a header that `other` lacks goes."""
    if odd := set(selected) - set(headers):
        raise ValueError(f"unknown headers {sorted(odd)}")
    return [F.col(f"{other if h in selected else own}.{h}").alias(h) for h in headers]


def merged_metadata(own: Column, other: Column, reserved: Sequence[str]) -> Column:
    """User metadata of `other`, but reserved keys keep their own value."""
    mine = F.map_filter(own, lambda k, _: k.isin(*reserved))
    return F.map_concat(F.map_filter(other, lambda k, _: ~k.isin(*reserved)), mine)


def upload_decision(of: DataFrame) -> DataFrame:
    """unchanged, check_hash or upload for a local file src against an object dst: size and exact stored time, then the stored hash, which has to be checked where the file's own is not known yet."""
    same_time = F.col("src.mtime_s").eqNullSafe(F.col("dst.mtime_s")) & F.col("src.mtime_ns").eqNullSafe(F.col("dst.mtime_ns"))
    out = F.when(F.col("dst").isNull(), "upload").when(F.col("src.size") != F.col("dst.size"), "upload").when(same_time, "unchanged").when(F.col("dst.hash").isNotNull() & F.col("src.hash").isNull(), "check_hash").when(F.col("src.hash") == F.col("dst.hash"), "unchanged").otherwise("upload")
    return of.filter("src is not null").select("path", out.alias("decision"))


def missing_objects(local: DataFrame, remote: DataFrame, on: str = "hash") -> DataFrame:
    """Contents that the other side lacks, once each."""
    return local.dropDuplicates([on]).join(remote.select(on).distinct(), on, "left_anti")


def expand_tracked(outputs: DataFrame, members: DataFrame) -> DataFrame:
    """Directory digests become their member files, plain outputs pass. members: digest, files as JSON [{md5, relpath}]."""
    files = members.select("digest", F.explode(F.from_json("files", "array<struct<md5:string,relpath:string>>")).alias("f"))
    dirs = outputs.filter(F.endswith("digest", F.lit(".dir"))).join(files, "digest").select(F.concat_ws("/", "path", "f.relpath").alias("path"), F.col("f.md5").alias("digest"))
    return outputs.filter(~F.endswith("digest", F.lit(".dir"))).select("path", "digest").unionByName(dirs)
