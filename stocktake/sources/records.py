"""Line-delimited JSON of listings, versions, mappings, results, history and trials, and publication of snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocktake.functions.paths import decode_path, encode_path, path_error
from stocktake.functions.values import digest_valid


MAPPING = "src string, dst string, kind string, hash string, mode int, mtime long"
RESULTS = "schema string, schema_version int, run long, seq long, type string, disposition string, dst string, bytes long, status string, diagnostic_for string"
# The result stream that is understood, and what a mapping line may hold.
SCHEMA, VERSION = "transfer.results", 1
TYPES = ("run", "trace", "operation_result", "error", "result", "progress", "selection_result", "removal_trace", "removal_result")
STATUSES = ("success", "partial", "refused", "aborted", "failed")
ENCODINGS = ("utf-8", "base64")
KINDS = ("file", "dir", "symlink", "special")
_TAGGED = "struct<encoding:string,value:string>"
_WIRE = f"src {_TAGGED}, dst {_TAGGED}, kind string, size long, mtime long, s3_last_modified long, expected_hash struct<algorithm:string,value:string>, metadata struct<mode:int,uid:long,gid:long,mtime:long,mtime_nsec:int>"
_WIRE_NAMES = ("src", "dst", "kind", "size", "mtime", "s3_last_modified", "expected_hash", "metadata")
LISTING = "bucket string, key string, size long, last_modified string, etag string"
VERSIONS = "key string, version string, marker boolean"


def line_numbers(lines: DataFrame) -> DataFrame:
    """lines of spark.read.text with line, from 1 in each file: places within each part of a file that a task reads, then the totals of the parts before."""
    at = lines.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")).withColumn("__m", F.monotonically_increasing_id())
    own = F.row_number().over(Window.partitionBy("__file", "__start").orderBy("__m"))
    sizes = at.groupBy("__file", "__start").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("__file", "__start", before.alias("__b"))
    return at.withColumn("line", own).join(parts, ["__file", "__start"]).withColumn("line", F.col("line") + F.col("__b")).drop("__file", "__start", "__m", "__b")


def read_listing(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """bucket, key, size, last_modified, etag and error of listing lines: no JSON, no key, a key outside the prefix."""
    row = spark.read.text(path).filter(F.trim("value") != "").withColumn("r", F.from_json("value", LISTING))
    error = F.when(F.json_object_keys("value").isNull(), "not_json").when(F.col("r.bucket").isNull() | F.col("r.key").isNull(), "missing_field").when(~F.startswith("r.key", F.lit(prefix)), "outside_prefix")
    return row.select("r.*", error.alias("error"))


def once_each(listing: DataFrame) -> DataFrame:
    """Each key once: a key that a listing repeats counts once when it is pruned."""
    return listing.dropDuplicates(["bucket", "key"])


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """key, version, marker and error of version lines: data versions and delete markers alike need a version id."""
    row = spark.read.text(path).filter(F.trim("value") != "").withColumn("r", F.from_json("value", VERSIONS))
    error = F.when(F.json_object_keys("value").isNull(), "not_json").when(F.col("r.key").isNull(), "missing_key").when(F.coalesce("r.version", F.lit("")) == "", "missing_version")
    return row.select("r.key", "r.version", F.coalesce("r.marker", F.lit(False)).alias("marker"), error.alias("error"))


def write_mapping(mapping: DataFrame, path: str, include: Sequence[str] = ("kind", "hash", "mode", "mtime")) -> None:
    """src and dst always, the rest on request; nulls are left out."""
    mapping.select(F.to_json(F.struct("src", "dst", *include)).alias("value")).write.text(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a mapping file with an error for lines that are no JSON object, lack src or dst, or hold unknown fields. Blank lines are skipped."""
    names = F.array(*(F.lit(x.split()[0]) for x in MAPPING.split(", ")))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    row = lines.withColumn("row", F.from_json("value", MAPPING))
    error = F.when(keys.isNull(), "not_json").when(F.size(F.array_except(keys, names)) > 0, "unknown_field").when(F.col("row.src").isNull() | F.col("row.dst").isNull(), "missing_field")
    return row.select("row.*", error.alias("error"))


def write_manifest(mapping: DataFrame, path: str, include: Sequence[str] = ()) -> DataFrame:
    """Mapping lines with tagged paths (text, or base64 where src or dst hold bytes that are no UTF-8).

    src, dst as strings or bytes, kind, expected_hash and metadata where mapping has
    them; include adds size, mtime or s3_last_modified, size and mtime for regular files only. Rows whose
    paths are refused are not written; they are returned with error.
    """
    raw = lambda c: F.col(c) if mapping.schema[c].dataType.simpleString() == "binary" else F.encode(c, "UTF-8")
    text = lambda c: F.when(F.is_valid_utf8(raw(c).cast("string")), raw(c).cast("string")).otherwise(F.regexp_replace(F.decode(raw(c), "ISO-8859-1"), "[^\\x00-\\x7F]", "?"))
    checked = mapping.withColumn("error", F.coalesce(path_error(text("src")), path_error(text("dst"))))
    plain = [c for c in ("kind", "expected_hash", "metadata") if c in mapping.columns]
    regular = lambda c: F.when(F.col("kind") == "file", F.col(c)) if c != "s3_last_modified" else F.col(c)
    line = F.to_json(F.struct(encode_path(raw("src")).alias("src"), encode_path(raw("dst")).alias("dst"), *plain, *(regular(c).alias(c) for c in include)))
    checked.filter("error is null").select(line.alias("value")).write.text(path)
    return checked.filter("error is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """line, src and dst as bytes, kind, expected_hash, metadata and error of mapping lines with tagged paths.

    Blank lines are skipped but counted. Refused: what is no JSON object, unknown or
    missing fields, unknown encodings and kinds, malformed or unsafe paths, digests of a wrong length or of
    anything but a regular file, a mode for a link.
    """
    rows = line_numbers(spark.read.text(path)).filter(F.trim("value") != "").withColumn("r", F.from_json("value", _WIRE))
    keys, known = F.json_object_keys("value"), F.array(*map(F.lit, _WIRE_NAMES))
    src, dst = (decode_path(F.col(f"r.{c}.encoding"), F.col(f"r.{c}.value")) for c in ("src", "dst"))
    odd = lambda c: ~F.col(f"r.{c}.encoding").isin(*ENCODINGS)
    shape = lambda c: path_error(F.regexp_replace(F.decode(c, "ISO-8859-1"), "[^\\x00-\\x7F]", "?"))
    digest = F.col("r.expected_hash")
    error = (
        F.when(keys.isNull(), "not_json")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown_field")
        .when(F.col("r.src.value").isNull() | F.col("r.dst.value").isNull() | F.col("r.src.encoding").isNull() | F.col("r.dst.encoding").isNull(), "missing_field")
        .when(odd("src") | odd("dst"), "unknown_encoding")
        .when(src.isNull() | dst.isNull(), "malformed_path")
        .when(shape(src).isNotNull() | shape(dst).isNotNull(), F.coalesce(shape(src), shape(dst)))
        .when(F.col("r.kind").isNotNull() & ~F.col("r.kind").isin(*KINDS), "unknown_kind")
        .when(digest.isNotNull() & ~digest_valid(F.col("r.expected_hash.algorithm"), F.col("r.expected_hash.value")), "bad_digest")
        .when(digest.isNotNull() & (F.coalesce("r.kind", F.lit("file")) != "file"), "digest_of_no_file")
        .when(F.col("r.metadata.mode").isNotNull() & (F.col("r.kind") == "symlink"), "mode_on_link")
    )
    return rows.select("line", src.alias("src"), dst.alias("dst"), "r.kind", "r.expected_hash", "r.metadata", error.alias("error"))


def parse_results(lines: DataFrame) -> DataFrame:
    """Known records of result lines (value), batch or stream, with an error.

    Unknown types are ignored. Another schema or version, a terminal status or a path
    encoding that is not known, and a known type without seq are errors.
    """
    row = lines.select(F.from_json("value", RESULTS).alias("r"), F.get_json_object("value", "$.dst.encoding").alias("__e")).select("r.*", "__e").filter(F.col("type").isin(*TYPES))
    error = (
        F.when(~F.col("schema").eqNullSafe(F.lit(SCHEMA)), "unknown_schema")
        .when(~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "unknown_version")
        .when(F.col("seq").isNull(), "missing_seq")
        .when((F.col("type") == "result") & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown_status")
        .when(F.col("__e").isNotNull() & ~F.col("__e").isin(*ENCODINGS), "unknown_encoding")
    )
    return row.withColumn("error", error).drop("__e")


def checked_results(lines: DataFrame) -> DataFrame:
    """parse_results without error: a record that has one fails the query."""
    of = parse_results(lines)
    return of.filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("result stream: "), F.col("error"))).cast("boolean"))).drop("error")


def result_lines(results: DataFrame) -> DataFrame:
    columns = ["run", "seq", "type", "disposition", "dst", "bytes", "status", "diagnostic_for"]
    return results.select(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit(VERSION).alias("schema_version"), *columns)).alias("value"))


def write_results(records: DataFrame, path: str) -> None:
    """Result lines of records(run, seq, ...), numbered as outcomes.numbered does; each run stands together in order, in one file or, if it is long, in files that follow each other."""
    records.repartitionByRange("run", "seq").sortWithinPartitions("run", "seq").transform(result_lines).write.text(path)


def write_history(measurements: DataFrame, path: str) -> None:
    """Observation lines of measurements(run, sequence, workers, rate)."""
    measurements.select(F.to_json(F.struct(F.lit("observation").alias("kind"), "run", "sequence", "workers", "rate")).alias("value")).write.mode("append").text(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The measurements of history lines: observations; lines of other kinds and lines that are no JSON are left out."""
    rows = spark.read.text(path).select(F.from_json("value", "kind string, run long, sequence int, workers long, rate double").alias("r")).select("r.*")
    return rows.filter("kind = 'observation'").drop("kind")


def append_events(events: DataFrame, path: str) -> None:
    """Append-only, by day."""
    events.write.partitionBy("day").mode("append").parquet(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial rows of files with a records array each."""
    rows = spark.read.schema("workload string, records array<struct<round:long,seconds:double,verified:boolean>>").json(path)
    return rows.select("workload", F.explode("records").alias("r")).select("workload", "r.*")


def snapshot(pairs: DataFrame, columns: Sequence[str], gone: Column) -> DataFrame:
    """The new destination state of pairs: the source's row where there is one, else the destination's unless it is gone."""
    kept = pairs.filter(F.col("src").isNotNull() | ~gone)
    return kept.select("path", *(F.when(F.col("src").isNotNull(), F.col(f"src.{c}")).otherwise(F.col(f"dst.{c}")).alias(c) for c in columns))
