"""Queries of sources and sinks: what is written is read back."""

from __future__ import annotations

import hashlib

import xxhash
from pyspark.sql import functions as F

from stocktake.operators import prune, reconcile
from stocktake.operators.mapping import parents_first
from stocktake.operators.ordering import numbered
from stocktake.operators.transform import consumed
from stocktake.sources import commits, files, folders, records, transfer
from stocktake.sources.scratch import new_folder, settle

from .registry import query

c = F.col


_FILE = "source || '/' || lang || '/' || doc_id || '.txt'"


# A folder that holds every document as a file; rules leave out some files and one folder with all below it.
@query("s01_scan_files", f"""
with f as (select {_FILE} as path, 'file' as kind, octet_length(encode(text))::bigint as size from documents),
e as (select * from f union all select distinct unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]), 'dir', null from f)
select row_number() over (order by string_split(path, '/')) as nth, path, kind, size from e where not (path = 'src1/en' or starts_with(path, 'src1/en/') or kind = 'file' and path like '%7.txt')""")
def s01(t):
    dst = F.concat_ws("/", "source", "lang", F.concat(c("doc_id").cast("string"), F.lit(".txt")))
    root = new_folder(t.spark, "scanned")
    settle(files.copy_files(t.documents.select(dst.alias("dst"), c("text").alias("content")), root), "copied")
    found = files.scan_files(t.spark, root, ("/src1/en/", "*7.txt"))
    return numbered(found, parents_first()).select("nth", "path", "kind", "size")


def _as_files(t, label):
    """A folder that holds every document as a file."""
    root = new_folder(t.spark, label)
    dst = F.concat_ws("/", "source", "lang", F.concat(c("doc_id").cast("string"), F.lit(".txt")))
    settle(files.copy_files(t.documents.select(dst.alias("dst"), c("text").alias("content")), root), "written")
    return root


# The same folder read as a data source, below two prefixes; the scan has no warnings, so the gate stays open for what it does not list.
@query("s01_folder_source", f"""
with f as (select {_FILE} as path, octet_length(encode(text))::bigint as size from documents), d as (select distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as folder from f)
select path, 'file' as kind, size, 'planned' as disposition from f where (starts_with(path, 'src2/') or starts_with(path, 'src3/de/')) and not path like '%7.txt'
union all select folder, 'dir', null, 'planned' from d where starts_with(folder, 'src2/') or folder = 'src3/de' union all select 'src2', 'dir', null, 'planned'""")
def s01_source(t):
    folders.register(t.spark)
    read = t.spark.read.format("folders").option("root", _as_files(t, "source")).option("ignore", "*7.txt").option("prefixes", "src2\nsrc3/de").option("partitions", 16).load()
    return prune.gated(read.filter("warning is null").select("path", "kind", "size"), read.filter("warning is not null"))


@query("s09_read_ranges", f"""
select path, b as block, b * 4096 as "offset", least(4096, n - b * 4096) as length, md5(unhex(hex(content)[b * 8192 + 1:b * 8192 + 8192])) as hash
from (select {_FILE} as path, encode(text) as content, octet_length(encode(text)) as n, unnest(range(0, (octet_length(encode(text)) + 4095) // 4096)) as b from documents)""")
def s09_ranges(t):
    root = _as_files(t, "ranges")
    listed = files.scan_files(t.spark, root).filter("kind = 'file'").select("path", c("size").alias("length"))
    return transfer.read_blocks(listed, root, 4096, "md5").filter("message is null").drop("message")


# Copied from folder to folder in parts of 1024 bytes; every thirteenth row promises another size, and the digest is that of the copy.
@query("s16_copy_from_root", f"""
select path as dst, case when ok then n else 0 end as bytes, case when ok then greatest(1, (n + 1023) // 1024) else 0 end as parts, case when ok then 'transferred' else 'failed' end as disposition, case when ok and n > 0 then sha256(text) end as hash
from (select 'to/' || {_FILE} as path, text, octet_length(encode(coalesce(text, ''))) as n, doc_id % 13 <> 5 as ok from documents)""")
def s16_copy(t):
    root, to = _as_files(t, "from"), new_folder(t.spark, "to")
    listed = files.scan_files(t.spark, root).filter("kind = 'file'")
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    plan = listed.select(c("path").alias("src"), F.concat(F.lit("to/"), "path").alias("dst"), (c("size") + F.when(number % 13 == 5, 1500).otherwise(0)).alias("size"))
    done = transfer.copy_files(plan, root, to, part=1024)
    copied = transfer.read_blocks(done.filter("disposition = 'transferred'").select(c("dst").alias("path"), F.lit(None).cast("long").alias("length")), to, 1024)
    return done.join(copied.filter("length > 0").select(c("path").alias("dst"), "hash"), "dst", "left").select("dst", "bytes", "parts", "disposition", "hash")


@query("s02_read_listing", "select distinct on (bucket, key) bucket, key from listing")
def s02(t):
    path = new_folder(t.spark, "listing")
    t.listing.select(F.to_json(F.struct("bucket", "key", "size", "etag")).alias("value")).write.text(path)
    return records.once_each(records.read_listing(t.spark, path).filter("error is null")).select("bucket", "key")


@query("s02_listing_errors", "select case when page_id % 5 = 0 then 'not_json' when page_id % 5 = 1 then 'missing_field' when starts_with('in/' || key, 'in/a') then null else 'outside_prefix' end as error, count(*) as n from listing group by 1")
def s02_errors(t):
    path = new_folder(t.spark, "listing")
    key = F.concat(F.lit("in/"), "key")
    line = F.when(c("page_id") % 5 == 0, F.concat(F.lit("["), "key")).when(c("page_id") % 5 == 1, F.to_json(F.struct("bucket", "size"))).otherwise(F.to_json(F.struct("bucket", key.alias("key"), "size")))
    t.listing.select(line.alias("value")).write.text(path)
    return records.read_listing(t.spark, path, "in/a").groupBy("error").agg(F.count("*").alias("n"))


@query("s04_read_versions", "select key, version, marker from versions where version is not null")
def s04(t):
    path = new_folder(t.spark, "versions")
    t.versions.select(F.to_json(F.struct("key", c("version").cast("string").alias("version"), F.when(c("marker"), True).alias("marker"))).alias("value")).write.text(path)
    return records.read_versions(t.spark, path).filter("error is null").select("key", c("version").cast("long").alias("version"), "marker")


@query("s04_version_errors", "select case when version % 3 = 0 then 'missing_version' when version % 3 = 1 then 'missing_key' end as error, count(*) as n from versions group by 1")
def s04_errors(t):
    path = new_folder(t.spark, "versions")
    v = c("version") % 3
    t.versions.select(F.to_json(F.struct(F.when(v != 1, c("key")).alias("key"), F.when(v != 0, c("version").cast("string")).alias("version"), "marker")).alias("value")).write.text(path)
    return records.read_versions(t.spark, path).groupBy("error").agg(F.count("*").alias("n"))


@query("s05_tagged_manifest", """
select (row_number() over (order by doc_id)) * 2 - 1 as line, hex(case when doc_id % 9 = 4 then unhex('66ff') else encode(src) end) as src, encode(dst)::blob as dst_, kind, case when doc_id % 3 = 0 then hash end as digest, mode,
  case when kind = 'dir' and false then 'x' end as error from mapping""".replace("encode(dst)::blob as dst_", "dst"))
def s05_manifest(t):
    d = c("doc_id")
    digest = F.when(d % 3 == 0, F.struct(F.lit("sha256").alias("algorithm"), c("hash").alias("value")))
    src = F.when(d % 9 == 4, F.unhex(F.lit("66ff"))).otherwise(F.encode("src", "UTF-8"))
    rows = t.mapping.select(src.alias("src"), "dst", "kind", digest.alias("expected_hash"), F.when(c("mode").isNotNull(), F.struct("mode")).alias("metadata"), "doc_id")
    path = new_folder(t.spark, "manifest")
    records.write_manifest(rows.repartition(1).sortWithinPartitions("doc_id").withColumn("doc_id", c("doc_id")), f"{path}-first")
    # a blank line after each: it is skipped, and counted
    t.spark.read.text(f"{path}-first").select(F.concat("value", F.lit("\n")).alias("value")).coalesce(1).write.text(path)
    got = records.read_manifest(t.spark, path)
    return got.select("line", F.hex("src").alias("src"), c("dst").cast("string").alias("dst"), "kind", c("expected_hash.value").alias("digest"), c("metadata.mode").alias("mode"), "error")


@query("s05_manifest_errors", """
select case doc_id % 8 when 0 then 'not_json' when 1 then 'unknown_field' when 2 then 'missing_field' when 3 then 'unknown_encoding' when 4 then 'malformed_path' when 5 then 'dot_component' when 6 then 'bad_digest' end as error, count(*) as n
from mapping group by 1""")
def s05_manifest_errors(t):
    d = c("doc_id") % 8
    tagged = lambda encoding, value: F.struct(F.lit(encoding).alias("encoding"), value.alias("value"))
    dst = tagged("utf-8", c("dst"))
    line = (
        F.when(d == 0, F.lit("{")).when(d == 1, F.to_json(F.struct(dst.alias("src"), dst.alias("dst"), F.lit(1).alias("extra")))).when(d == 2, F.to_json(F.struct(dst.alias("dst"))))
        .when(d == 3, F.to_json(F.struct(tagged("utf-16", c("src")).alias("src"), dst.alias("dst")))).when(d == 4, F.to_json(F.struct(tagged("base64", F.lit("a*b")).alias("src"), dst.alias("dst"))))
        .when(d == 5, F.to_json(F.struct(tagged("utf-8", F.concat(F.lit("../"), "src")).alias("src"), dst.alias("dst"))))
        .when(d == 6, F.to_json(F.struct(dst.alias("src"), dst.alias("dst"), F.struct(F.lit("md5").alias("algorithm"), c("hash").alias("value")).alias("expected_hash")))).otherwise(F.to_json(F.struct(dst.alias("src"), dst.alias("dst"))))
    )
    path = new_folder(t.spark, "manifest")
    t.mapping.select(line.alias("value")).write.text(path)
    return records.read_manifest(t.spark, path).groupBy("error").agg(F.count("*").alias("n"))


@query("s07_result_errors", "select case when status is null and type = 'result' then 'unknown_status' when run % 4 = 0 then 'unknown_schema' when run % 4 = 1 then 'unknown_version' end as error, count(*) as n from (select run, type, case when run % 4 = 2 then null else status end as status from results) group by 1".replace("when status is null and type = 'result' then 'unknown_status' when run % 4 = 0 then 'unknown_schema' when run % 4 = 1 then 'unknown_version'", "when run % 4 = 0 then 'unknown_schema' when run % 4 = 1 then 'unknown_version' when status is null and type = 'result' then 'unknown_status'"))
def s07_errors(t):
    r = c("run") % 4
    lines = records.result_lines(t.results.withColumn("status", F.when(r == 2, "odd").otherwise(c("status"))))
    of = c("value")
    of = F.when(r == 0, F.replace(of, F.lit(records.SCHEMA), F.lit("other"))).when(r == 1, F.replace(of, F.lit('"schema_version":1'), F.lit('"schema_version":2'))).otherwise(of)
    return records.parse_results(lines.withColumn("run", F.get_json_object("value", "$.run").cast("long")).select(of.alias("value"))).groupBy("error").agg(F.count("*").alias("n"))


@query("s05_read_mapping", "select src, dst, kind, hash, mode, mtime, null::varchar as error from mapping")
def s05(t):
    path = new_folder(t.spark, "mapping")
    records.write_mapping(t.mapping, path)
    return records.read_mapping(t.spark, path)


@query("s05_mapping_errors", "select case doc_id % 4 when 0 then null when 1 then 'not_json' when 2 then 'unknown_field' else 'missing_field' end as error, count(*) as n from mapping group by 1")
def s05e(t):
    d = c("doc_id")
    line = F.when(d % 4 == 0, F.to_json(F.struct("src", "dst"))).when(d % 4 == 1, F.concat(F.lit("{"), "src")).when(d % 4 == 2, F.to_json(F.struct("src", "dst", F.lit(1).alias("extra")))).otherwise(F.to_json(F.struct("src")))
    path = new_folder(t.spark, "mapping")
    t.mapping.select(line.alias("value")).write.text(path)
    return records.read_mapping(t.spark, path).groupBy("error").agg(F.count("*").alias("n"))


@query("s06_write_mapping", "select count(*) as lines, count(kind) as kinds from mapping")
def s06(t):
    path = new_folder(t.spark, "mapping")
    records.write_mapping(t.mapping, path, ("kind",))
    return t.spark.read.text(path).agg(F.count("*").alias("lines"), F.count_if(F.contains("value", F.lit('"kind"'))).alias("kinds"))


@query("s07_read_results", "select run, seq, type, disposition, status from results where type <> 'trace' or run % 2 = 0")
def s07(t):
    path = new_folder(t.spark, "results")
    odd = F.when((c("type") == "trace") & (c("run") % 2 == 1), "novelty").otherwise(c("type"))
    records.result_lines(t.results.withColumn("type", odd)).write.text(path)
    return records.parse_results(t.spark.read.text(path)).filter("error is null").select("run", "seq", "type", "disposition", "status")


@query("s10_history", "select run, sequence, workers, rate from measurements")
def s10(t):
    path = new_folder(t.spark, "history")
    t.measurements.select(F.lit('{"kind":"note"}').alias("value")).write.text(path)
    records.write_history(t.measurements, path)
    return records.read_history(t.spark, path)


@query("s12_append_events", "select day, count(*) as n from download_events group by day")
def s12(t):
    path = new_folder(t.spark, "events")
    for half in (0, 1):
        records.append_events(t.download_events.filter(c("event_id") % 2 == half), path)
    return t.spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"))


# Every batch comes twice, as after a failure; a third attempt has written other rows under a number that is taken.
@query("s12_append_once", "select day, count(*) as n from download_events group by day")
def s12_once(t):
    path = new_folder(t.spark, "events")
    for number in (0, 0, 1, 1):
        commits.append_once(t.download_events.filter(c("event_id") % 2 == number), path, "downloads", number, ("day",))
    commits.append_once(t.download_events, path, "downloads", 1, ("day",))
    return commits.appended(t.spark, path).groupBy("day").agg(F.count("*").alias("n"))


# Two runs build on version 1: the second to commit is refused, works its state out again from what it finds, and is version 3.
@query("s15_concurrent_publish", "select path, size + (doc_id % 2 = 0)::int + (doc_id % 3 = 0)::int as size, 3::bigint as version from inv_src")
def s15_concurrent(t):
    root = new_folder(t.spark, "versions")
    grown = lambda df, by: df.withColumn("size", c("size") + (c("doc_id") % by == 0).cast("long"))
    base = commits.publish(t.spark, t.inv_src.select("path", "size", "doc_id"), root)
    mine, theirs = (grown(commits.published(t.spark, root, base), by) for by in (2, 3))
    commits.publish(t.spark, theirs, root, base)
    try:
        last = commits.publish(t.spark, mine, root, base)
    except commits.Conflict:
        base = commits.head(t.spark, root)
        last = commits.publish(t.spark, grown(commits.published(t.spark, root, base), 2), root, base)
    return commits.published(t.spark, root).select("path", "size", F.lit(last).cast("long").alias("version"))


@query("s14_read_trials", """select "case" || variant as workload, round, seconds, verified from trials""")
def s14(t):
    path = new_folder(t.spark, "trials")
    rows = t.trials.withColumn("workload", F.concat("case", "variant")).groupBy("workload", F.floor(c("round") / 1000))
    rows.agg(F.collect_list(F.struct("round", "seconds", "verified")).alias("records")).select("workload", "records").write.json(path)
    return records.read_trials(t.spark, path).withColumn("round", c("round").cast("int"))


@query("s15_snapshot_write", "select path, size, hash from inv_src union all select path, size, hash from inv_dst where path not in (select path from inv_src) and doc_id % 2 = 0")
def s15(t):
    root = new_folder(t.spark, "snapshot")
    commits.publish(t.spark, t.inv_dst.select("path", "size", "hash"), root)
    plan = reconcile.pairs(commits.published(t.spark, root).join(t.inv_dst.select("path", "doc_id"), "path").alias("d"), t.inv_src)
    new = records.snapshot(plan.select("path", c("dst").alias("src"), c("src").alias("dst")), ["size", "hash"], c("dst.doc_id") % 2 == 1)
    commits.publish(t.spark, new, root, 1)
    return commits.published(t.spark, root)


@query("s16_copy_files", "select source || '/' || doc_id || '.txt' as dst, octet_length(encode(text))::bigint as bytes, 'transferred' as disposition from documents")
def s16(t):
    dst = F.concat_ws("/", "source", F.concat(c("doc_id").cast("string"), F.lit(".txt")))
    return settle(files.copy_files(t.documents.select(dst.alias("dst"), c("text").alias("content")), new_folder(t.spark, "copied")), "copied").drop("message")


# Copies whose promised size is wrong, or whose name leaves the root, fail; the others are there.
@query("s16_failed_copies", "select case when doc_id % 5 = 0 then '../' else '' end || source || '/' || doc_id || '.txt' as dst, case when doc_id % 5 < 2 then 0 else octet_length(encode(text)) end::bigint as bytes, case when doc_id % 5 < 2 then 'failed' else 'transferred' end as disposition, doc_id % 5 >= 2 as there from documents")
def s16_failed(t):
    d, root = c("doc_id"), new_folder(t.spark, "copied")
    name = F.concat_ws("/", "source", F.concat(d.cast("string"), F.lit(".txt")))
    rows = t.documents.select(F.when(d % 5 == 0, F.concat(F.lit("../"), name)).otherwise(name).alias("dst"), c("text").alias("content"), (F.octet_length("text") + (d % 5 == 1).cast("int")).alias("size"))
    done = settle(files.copy_files(rows, root), "copied")
    there = files.scan_files(t.spark, root).filter("kind = 'file'").select(c("path").alias("dst"), F.lit(True).alias("there"))
    return done.join(there, "dst", "left").select("dst", "bytes", "disposition", F.coalesce("there", F.lit(False)).alias("there"))


@query("s17_remove_files", "select source || '/' || doc_id || '.txt' as path, case when doc_id % 3 = 0 then 'already_absent' else 'removed' end as disposition from documents union all select distinct source, 'removed' from documents where doc_id % 3 <> 0")
def s17(t):
    root = new_folder(t.spark, "copied")
    dst = F.concat_ws("/", "source", F.concat(c("doc_id").cast("string"), F.lit(".txt")))
    there = t.documents.select("doc_id", "source", dst.alias("dst"), c("text").alias("content"))
    settle(files.copy_files(there.filter("doc_id % 3 != 0"), root), "copied")
    plan = there.select(c("dst").alias("path"), F.lit("file").alias("kind")).union(there.filter("doc_id % 3 != 0").select("source", F.lit("dir")).distinct())
    return files.remove_files(plan, root).drop("message")


# Folders that still hold a file that the plan does not name are kept, and so is the file.
@query("s17_kept_folders", """
select path, disposition from (select source || '/' || doc_id || '.txt' as path, 'removed' as disposition from documents where doc_id % 3 <> 0
union all select source, case when bool_or(doc_id % 3 = 0) then 'kept' else 'removed' end from documents group by source
union all select 'left:' || source || '/' || doc_id || '.txt', 'file' from documents where doc_id % 3 = 0)""")
def s17_kept(t):
    root = new_folder(t.spark, "copied")
    dst = F.concat_ws("/", "source", F.concat(c("doc_id").cast("string"), F.lit(".txt")))
    there = t.documents.select("doc_id", "source", dst.alias("dst"), c("text").alias("content"))
    settle(files.copy_files(there, root), "copied")
    plan = there.filter("doc_id % 3 != 0").select(c("dst").alias("path"), F.lit("file").alias("kind")).union(there.select("source", F.lit("dir")).distinct())
    done = files.remove_files(plan, root).drop("message")
    left = files.scan_files(t.spark, root).filter("kind = 'file'").select(F.concat(F.lit("left:"), "path").alias("path"), F.lit("file").alias("disposition"))
    return done.union(left)


@query("x04_producer", "select source || '/' || doc_id as dst, 5::bigint + octet_length(encode(text)) as bytes from documents")
def x04(t):
    rows = t.documents.select(F.concat_ws("/", "source", c("doc_id").cast("string")).alias("dst"), c("text").alias("content"))
    return settle(files.copy_files(rows, new_folder(t.spark, "produced"), lambda data: b"head\n" + data).select("dst", "bytes"), "produced")


@query("x05_consumer", "select doc_id, sha256(text) as digest from documents")
def x05(t):
    rows = t.documents.select("doc_id", c("text").alias("content"))
    return consumed(rows, "doc_id", lambda data: hashlib.sha256(data).hexdigest(), "digest string")


# No SQL: the hash is not a function of the oracle; tests compare it with the library itself.
@query("x07_extra_hash")
def x07(t):
    return consumed(t.documents.select("doc_id", c("text").alias("content")), "doc_id", xxhash.xxh3_128_hexdigest, "xxh3_128 string")
