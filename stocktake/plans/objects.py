"""Queries of object listings, versions and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.functions.checksums import CRC64NVME, crc
from stocktake.functions.values import is_directory_marker
from stocktake.operators import objects as O
from stocktake.operators import reconcile
from stocktake.operators.content import checked_parts
from stocktake.operators.ordering import numbered

from .registry import query

c = F.col


@query("s03_listing_children", "select bucket, case when contains(key, '/') then split_part(key, '/', 1) || '/' else key end as name, count(*) as n, sum(size)::bigint as size from listing where key <> '' group by all")
def s03(t):
    return O.children(t.listing, "")


@query("f12_marker_errors", "select key, page_id, case when page_id % 3 = 0 and suffix(key, '/') and size > 0 then 'marker_with_data' end as error from listing")
def f12(t):
    return t.listing.select("key", "page_id", F.when(is_directory_marker(c("key"), F.lit(0)) & (c("size") > 0) & (c("page_id") % 3 == 0), "marker_with_data").alias("error"))


def _object(prefix: str, changed: bool):
    d = c("doc_id")
    alg = F.when(d % 4 == 0, "sha256").when(d % 4 == 1, "blake3")
    return F.struct(
        F.when(d % 19 == 0, "dir").otherwise("file").alias("kind"), (c("size") + (d % 10 == 3).cast("int") * int(changed)).alias("size"),
        (F.when(d % 8 == 5, F.lit("md5")).otherwise(alg) if changed else alg).alias("hash_algorithm"), F.when(alg.isNotNull(), F.when((d % 12 == 4) & F.lit(changed), "x").otherwise(c("hash"))).alias("hash"),
        F.when(d % 3 == 0, "FULL_OBJECT").otherwise("COMPOSITE").alias("checksum_type"), F.when(d % 6 == 3, F.when((d % 18 == 15) & F.lit(changed), "y").otherwise(c("hash"))).alias("sha256"), F.when(d % 2 == 0, "z").alias("crc64"),
        F.when((d % 7 == 2) & F.lit(changed), F.concat("hash", F.lit("-2"))).otherwise(c("hash")).alias("etag"),
        F.when(d % 5 == 0, "text/plain").alias("content_type"), *(F.lit(None).cast("string").alias(h) for h in O.HEADERS[1:]),
        F.when(d % 9 == 1, F.create_map(F.lit("owner"), F.lit("a"), F.lit("k"), F.when((d % 27 == 10) & F.lit(changed), "2").otherwise("1"))).alias("user_metadata"),
        F.create_map(F.lit("t"), d.cast("string")).alias("tags"), F.when((d % 2 == 0) & F.lit(changed), "STANDARD").alias("storage_class"),
    ).alias(prefix)


def _pairs(t):
    return t.inv_src.select("path", "doc_id", _object("src", False), _object("dst", True))


@query("a09_object_same_contents", """
select path, case when doc_id % 10 = 3 then false when doc_id % 19 = 0 then true when doc_id % 4 in (0, 1) and doc_id % 8 <> 5 then doc_id % 12 <> 4
  when doc_id % 3 = 0 and doc_id % 6 = 3 then doc_id % 18 <> 15 when doc_id % 3 = 0 and doc_id % 2 = 0 then true else doc_id % 7 <> 2 end as same from inv_src""")  # fmt: skip
def a09(t):
    return _pairs(t).select("path", O.same_contents(F.lit(False)).alias("same"))


# Texts as local files in parts of 512 bytes: the store's checksum of the whole comes from those of the parts.
@query("a09_local_checksums", """
select doc_id, case when n <= 512 then md5(content) else (select md5(unhex(string_agg(md5(unhex(hex(content)[b * 1024 + 1:b * 1024 + 1024])), '' order by b))) || '-' || count(*) from (select unnest(range(0, (n + 511) // 512)) as b)) end as etag, true as same
from (select doc_id, encode(text) as content, octet_length(encode(text)) as n from documents where text is not null)""")  # fmt: skip
def a09_local(t):
    contents = t.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    found = O.local_checksums(checked_parts(contents, 512, "doc_id"), "doc_id")
    direct = contents.select(c("doc_id").alias("of"), F.base64(F.unhex(F.lpad(F.hex(crc("content", CRC64NVME)), 16, "0"))).alias("direct"))
    return found.join(direct, c("doc_id") == c("of")).select("doc_id", "etag", (c("crc64") == c("direct")).alias("same"))


# Without its own digest a file cannot be told from an object by the stored one.
@query("a12_unknown_digest", """
select s.path, case when d.path is null or s.size <> d.size then 'upload' when s.mtime_s = d.mtime_s and s.mtime_ns = d.mtime_ns then 'unchanged' when s.doc_id % 2 = 0 then 'check_hash' when s.hash = d.hash then 'unchanged' else 'upload' end as decision from inv_src s left join inv_dst d using (path)""")
def a12_unknown(t):
    return O.upload_decision(reconcile.pairs(t.inv_src.withColumn("hash", F.when(c("doc_id") % 2 != 0, c("hash"))), t.inv_dst))


@query("a10_object_same_attributes", "select path, doc_id % 27 <> 10 as same from inv_src")
def a10(t):
    return _pairs(t).select("path", O.same_attributes().alias("same"))


@query("a11_merge_selected_attributes", "select path, 'owner=me,' || 'k=' || (doc_id % 7) as merged from inv_src")
def a11(t):
    own = F.create_map(F.lit("owner"), F.lit("me"), F.lit("old"), F.lit("1"))
    other = F.create_map(F.lit("owner"), F.lit("them"), F.lit("k"), (c("doc_id") % 7).cast("string"))
    merged = O.merged_metadata(own, other, ["owner"])
    return t.inv_src.select("path", F.concat(F.lit("owner="), merged["owner"], F.lit(",k="), merged["k"]).alias("merged"))


@query("a11_merged_headers", "select path, case when doc_id % 4 = 0 then 'b' end as content_type, 'gzip' as content_encoding from inv_src")
def a11_headers(t):
    sides = lambda n, kind, coding: F.struct(kind.alias("content_type"), F.lit(coding).alias("content_encoding"), *(F.lit(None).cast("string").alias(h) for h in O.HEADERS[2:])).alias(n)
    rows = t.inv_src.select("path", sides("own", F.lit("a"), "gzip"), sides("other", F.when(c("doc_id") % 4 == 0, "b"), "br"))
    return rows.select("path", *O.merged_headers("own", "other", ["content_type"])).select("path", "content_type", "content_encoding")


@query("j16_version_of_a_tree", "select key, version from versions where version = 1")
def j16_tree(t):
    below = t.versions.withColumn("key", F.concat(F.lit("t/"), "key"))
    selectors = t.spark.createDataFrame([("t", True, 1)], "path string, tree boolean, version long")
    return O.versions_of(selectors, below).select(F.substring("key", 3, 100).alias("key"), "version")


@query("a12_upload_decision", """
select s.path, case when d.path is null or s.size <> d.size then 'upload' when s.mtime_s = d.mtime_s and s.mtime_ns = d.mtime_ns then 'unchanged' when s.hash = d.hash then 'unchanged' else 'upload' end as decision from inv_src s left join inv_dst d using (path)""")
def a12(t):
    return O.upload_decision(reconcile.pairs(t.inv_src, t.inv_dst))


def _covered(t):
    return t.listing.filter("page_id % 2 = 0").select(F.substring_index("key", "/", 1).alias("path")).distinct()


@query("j11_listed_state", """
select k.key, case when k.page_id % 3 = 0 then 'present' when exists (select 1 from listing l where l.page_id % 2 = 0 and split_part(l.key, '/', 1) in (k.key, split_part(k.key, '/', 1))) then 'absent' else 'unknown' end as state
from (select min(page_id) as page_id, key from listing group by key) k""")  # fmt: skip
def j11(t):
    keys = t.listing.groupBy("key").agg(F.min("page_id").alias("page_id"))
    return O.listed_state(keys.select("key"), keys.filter("page_id % 3 = 0"), _covered(t))


@query("j14_missing_objects", "select distinct hash from inv_src where hash not in (select hash from inv_dst)")
def j14(t):
    return O.missing_objects(t.inv_src, t.inv_dst).select("hash")


@query("j16_versions_of", "select key, version from versions where key::bigint % 4 = 0 or (key::bigint % 4 = 1 and version = 1)")
def j16(t):
    key = c("key").cast("long")
    selectors = t.versions.filter(key % 4 < 2).select(c("key").alias("path"), (key % 8 == 4).alias("tree"), F.when(key % 4 == 1, 1).cast("long").alias("version")).distinct()
    return O.versions_of(selectors, t.versions).select("key", "version")


@query("o03_markers_last", "select row_number() over (order by marker, key, version) as nth, key, version from versions")
def o03(t):
    return numbered(O.with_phase(t.versions), ["phase", "key", "version"]).select("nth", "key", "version")


@query("o03_all_markers_last", "select row_number() over (order by marker, key, version) as nth, key, version from versions")
def o03_all(t):
    return numbered(O.with_phase(t.versions), ["phase", "key", "version"]).select("nth", "key", "version")


@query("o03_markers_kept_on_failure", "select key, version from versions where not marker")
def o03k(t):
    return O.markers_kept(t.versions, t.versions.filter("version = 0")).select("key", "version")


@query("s13_expand_tracked", """
select 'out/' || conv_id || '/' || turn as path, md5(text) as digest from conversations where conv_id % 2 = 0
union all select 'out/' || conv_id, md5('f' || conv_id) from (select distinct conv_id from conversations where conv_id % 2 = 1)""")  # fmt: skip
def s13(t):
    conv = t.conversations
    digest = F.when(c("conv_id") % 2 == 0, F.concat(c("conv_id").cast("string"), F.lit(".dir"))).otherwise(F.md5(F.concat(F.lit("f"), c("conv_id").cast("string"))))
    outputs = conv.select("conv_id").distinct().select(F.concat(F.lit("out/"), c("conv_id").cast("string")).alias("path"), digest.alias("digest"))
    files = F.to_json(F.collect_list(F.struct(F.md5("text").alias("md5"), c("turn").cast("string").alias("relpath"))))
    members = conv.filter("conv_id % 2 = 0").groupBy("conv_id").agg(files.alias("files")).select(F.concat(c("conv_id").cast("string"), F.lit(".dir")).alias("digest"), "files")
    return O.expand_tracked(outputs, members)
