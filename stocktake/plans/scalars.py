"""Queries of the scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.functions import paths as P
from stocktake.functions import predicates as Q
from stocktake.functions import values as V

from .registry import query

c = F.col

_SCALARS = {
    # name: (table, Column by alias, SQL by alias)
    "f01_path_name": ("inv_src", {"name": lambda: P.path_name(c("path"))}, {"name": "list_last(string_split(path, '/'))"}),
    "f02_path_extension": ("inv_src", {"extension": lambda: P.path_extension(c("path"))}, {"extension": "regexp_extract(list_last(string_split(path, '/')), '^.+\\.([^.]*)$', 1)"}),
    "f03_path_parent_depth": ("inv_src", {"parent": lambda: P.path_parent(c("path")), "depth": lambda: P.path_depth(c("path"))}, {"parent": "regexp_replace(path, '/[^/]*$', '')", "depth": "len(string_split(path, '/')) - 1"}),
    "f04_path_ancestors": ("inv_dst", {"ancestors": lambda: P.path_ancestors(c("path"))}, {"ancestors": "list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))"}),
    "f05_path_join": ("inv_src", {"joined": lambda: P.path_join(F.when(c("doc_id") % 3 == 0, "").otherwise(c("hash")), c("path"))}, {"joined": "case when doc_id % 3 = 0 then path else hash || '/' || path end"}),
    "f06_path_relative": ("inv_dst", {"below": lambda: P.path_relative(c("path"), F.lit("extra")), "same": lambda: P.path_relative(c("path"), c("path")), "near": lambda: P.path_relative(c("path"), F.lit("ext"))}, {"below": "case when starts_with(path, 'extra/') then path[7:] end", "same": "''", "near": "null::varchar"}),
    "f07_expression_path": ("inv_dst", {"expression": lambda: P.expression_path(c("path"), P.path_relative(c("path"), F.when(c("doc_id") % 2 == 0, c("path")).otherwise("")))}, {"expression": "case when doc_id % 2 = 0 then list_last(string_split(path, '/')) else path end"}),
    "f08_validate_path": (
        "inv_src",
        {"error": lambda: P.path_error(F.concat(F.when(c("doc_id") % 5 == 1, "/").when(c("doc_id") % 5 == 2, "../").when(c("doc_id") % 5 == 3, "a//").otherwise(""), c("path")))},
        {"error": "case doc_id % 5 when 1 then 'absolute' when 2 then 'dot_component' when 3 then 'empty_component' end"},
    ),
    "f09_decode_encode_path": (
        "inv_src",
        {"text": lambda: P.decode_path(F.lit("base64"), F.base64(F.encode(c("path"), "UTF-8"))).cast("string"), "bad": lambda: P.decode_path(F.lit("base64"), F.concat(c("path"), F.lit("!"))).isNull(), "encoding": lambda: P.encode_path(F.unhex(F.concat(F.when(c("doc_id") % 2 == 0, "ff").otherwise("41"), F.lit("42"))))["encoding"]},
        {"text": "path", "bad": "true", "encoding": "case when doc_id % 2 = 0 then 'base64' else 'utf-8' end"},
    ),
    "f10_entry_kind_of": ("inv_src", {"k": lambda: V.entry_kind_of(F.element_at(F.array(*(F.lit(x) for x in (0o100644, 0o040755, 0o120777, 0o010644, 0o140755, 0o020600, 0o060600, 0o777))), (c("doc_id") % 8 + 1).cast("int")))}, {"k": "['file', 'dir', 'symlink', 'fifo', 'socket', 'char', 'block', 'other'][doc_id % 8 + 1]"}),
    "f11_mapping_kind": ("inv_src", {"k": lambda: V.mapping_kind(c("kind"))}, {"k": "case when kind = 'fifo' then 'special' else kind end"}),
    "f12_directory_marker": ("listing", {"marker": lambda: V.is_directory_marker(F.when(c("page_id") % 4 == 0, F.concat("key", F.lit("/"))).otherwise(c("key")), F.when(c("page_id") % 3 == 0, 0).otherwise(c("size")))}, {"marker": "page_id % 3 = 0 and (page_id % 4 = 0 or suffix(key, '/'))"}),
    "f13_permission_bits": ("inv_dst", {"bits": lambda: V.permission_bits(c("mode") + 0o100000)}, {"bits": "mode"}),
    "f14_ts_nanos": ("inv_src", {"nanos": lambda: V.ts_nanos(c("mtime_s"), c("mtime_ns")).cast("string")}, {"nanos": "(mtime_s::hugeint * 1000000000 + mtime_ns)::varchar"}),
    "f14_durations": (
        "inv_src",
        {"later_s": lambda: V.add_duration(c("mtime_s"), c("mtime_ns"), c("doc_id") * 1500000000 - 10**18)["seconds"], "later_ns": lambda: V.add_duration(c("mtime_s"), c("mtime_ns"), c("doc_id") * 1500000000 - 10**18)["nanos"], "apart": lambda: V.ts_diff(c("mtime_s"), c("mtime_ns"), F.lit(1700000000), F.lit(5)).cast("long")},
        {"later_s": "mtime_s - 1000000000 + (mtime_ns + doc_id * 1500000000) // 1000000000", "later_ns": "((mtime_ns + doc_id * 1500000000) % 1000000000)::int", "apart": "(mtime_s - 1700000000) * 1000000000 + mtime_ns - 5"},
    ),
    "f15_preferred_time": ("inv_src", {"at": lambda: V.preferred_time(F.when(c("doc_id") % 2 == 0, c("mtime_s")), c("doc_id"))}, {"at": "case when doc_id % 2 = 0 then mtime_s else doc_id end"}),
    "f17_mtime_matches_coarse": ("inv_src", {"near": lambda: V.mtime_matches_coarse(c("mtime_s"), c("mtime_s") + c("doc_id") % 4)}, {"near": "doc_id % 4 <= 1"}),
    "f18_literals": (
        "inv_src",
        {"size_": lambda: V.quantity(F.concat((c("doc_id") % 1000).cast("string"), F.lit(".5MiB")), V.SIZE_UNITS), "duration": lambda: V.quantity(F.concat((c("doc_id") % 90).cast("string"), F.lit("d")), V.DURATION_UNITS), "part": lambda: V.quantity(F.concat((c("doc_id") % 1000).cast("string"), F.lit(".5B")), V.SIZE_UNITS)},
        {"size_": "(doc_id % 1000) * 1048576 + 524288", "duration": "(doc_id % 90) * 86400000000000", "part": "null::bigint"},
    ),
    "f19_parse_rate": (
        "inv_src",
        {"bare": lambda: V.parse_rate(c("doc_id").cast("string")), "si": lambda: V.parse_rate(F.concat(c("doc_id").cast("string"), F.lit("kb"))), "low": lambda: V.parse_rate(F.concat((c("doc_id") % 500 + 1).cast("string"), F.lit("b"))), "odd": lambda: V.parse_rate(F.concat(c("doc_id").cast("string"), F.lit("xyz")))},
        {"bare": "doc_id * 1024", "si": "(doc_id * 1000 + 512) // 1024 * 1024", "low": "null::bigint", "odd": "null::bigint"},
    ),
    "f20_formats": (
        "inv_src",
        {"bytes": lambda: V.human_bytes(c("size")), "clock": lambda: V.hms(c("size").cast("double")), "commas": lambda: V.with_commas(c("size") * 1000)},
        {"bytes": "case when size < 1024 then size || ' B' when size < 10240 then format('{:.2f} KiB', size / 1024) when size < 102400 then format('{:.1f} KiB', size / 1024) when size < 1048576 then format('{:.0f} KiB', size / 1024) else format('{:.2f} MiB', size / 1048576) end",
         "clock": "case when size >= 3600 then format('{}:{:02d}:{:02d}', size // 3600, size // 60 % 60, size % 60) else format('{}:{:02d}', size // 60, size % 60) end", "commas": "format('{:,}', size * 1000)"},
    ),
    "f21_digest_valid": ("inv_src", {"ok": lambda: V.digest_valid(F.when(c("doc_id") % 2 == 0, "sha256").otherwise("md5"), c("hash")), "none": lambda: V.digest_valid(F.lit("crc"), c("hash"))}, {"ok": "doc_id % 2 = 0", "none": "false"}),
    "f22_digest_parse": ("inv_src", {"algorithm": lambda: V.digest_parse(F.concat(F.lit("sha256:"), F.upper("hash")))["algorithm"], "value": lambda: V.digest_parse(F.concat(F.lit("sha256:"), F.upper("hash")))["value"]}, {"algorithm": "'sha256'", "value": "hash"}),
    "f23_content_hash": ("documents", {"sha256": lambda: V.content_hash(c("text"), "sha256"), "md5": lambda: V.content_hash(c("text"), "md5")}, {"sha256": "sha256(text)", "md5": "md5(text)"}),
    "f24_normalized_md5": ("documents", {"same": lambda: V.normalized_md5_matches(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.md5("text")), "other": lambda: V.normalized_md5_matches(c("text"), F.md5("lang"))}, {"same": "true", "other": "false"}),
    "f25_leftover_names": (
        "inv_src",
        {
            "partial": lambda: P.is_partial_name(F.concat("path", F.when(c("doc_id") % 3 == 0, "/.a.transfer-partial-abcdefgh234567ab").otherwise("/.a.transfer-partial-abc"))),
            "object": lambda: P.is_object_partial_name(F.concat(F.lit("a/.transfer-s3-"), F.when(c("doc_id") % 2 == 0, c("hash")).otherwise("0"), F.lit(".partial"))),
            "recovery": lambda: P.is_recovery_name(F.concat(F.when(c("doc_id") % 5 == 0, ".transfer-swap-12-3/").otherwise(".transfer-swap-12/"), c("path"))),
        },
        {"partial": "doc_id % 3 = 0", "object": "doc_id % 2 = 0", "recovery": "doc_id % 5 = 0"},
    ),
    "f26_version_matches": ("inv_src", {"fits": lambda: V.version_matches(F.concat((c("doc_id") % 4).cast("string"), F.lit("."), (c("doc_id") % 7).cast("string"), F.lit(".0")), ">=1.2.0,<2.0.0|=3.0.0")}, {"fits": "(doc_id % 4 = 1 and doc_id % 7 >= 2) or (doc_id % 4 = 3 and doc_id % 7 = 0)"}),
    "f27_dst_rewrites": ("inv_src", {"dst": lambda: V.dst_by_time(c("mtime_s"), c("path")), "daily": lambda: V.dst_by_time(c("mtime_s"), P.path_name(c("path")), "yyyy/MM/dd")}, {"dst": "strftime(make_timestamp(mtime_s * 1000000), '%Y/%m') || '/' || lower(path)", "daily": "strftime(make_timestamp(mtime_s * 1000000), '%Y/%m/%d') || '/' || doc_id || '.txt'"}),
    "f28_object_version_uri": ("listing", {"uri": lambda: V.object_version_uri(c("bucket"), F.concat("key", F.lit("/ü *~.txt")), F.lit("v/1"))}, {"uri": "url_encode(bucket) || '/' || replace(url_encode(key), '%2F', '/') || '/%C3%BC%20%2A~.txt?versionId=v%2F1'"}),
    "f29_epoch_day_to_date": ("inv_src", {"day": lambda: V.epoch_day_to_date(F.floor(c("mtime_s") / 86400))}, {"day": "date '1970-01-01' + (mtime_s // 86400)::int"}),
    "p01_null_safe_equality": ("inv_src", {"same": lambda: Q.equal(c("link_target"), F.lit(None).cast("string")), "differs": lambda: ~Q.equal(c("link_target"), F.lit("../en"))}, {"same": "link_target is not distinct from null", "differs": "link_target is distinct from '../en'"}),
    "p02_ordering": ("inv_src", {"less": lambda: Q.less(c("path"), F.lit("src5")), "larger": lambda: Q.less(F.lit(2000), c("size"))}, {"less": "path < 'src5'", "larger": "size > 2000"}),
    "p03_short_circuit": ("inv_src", {"guarded": lambda: Q.both(c("doc_id") != 0, Q.divided(F.lit(1000), c("doc_id")) > 3), "open": lambda: Q.either(c("doc_id") == 0, Q.divided(F.lit(1000), c("doc_id")) > 3)}, {"guarded": "case when doc_id <> 0 then 1000 // doc_id > 3 else false end", "open": "case when doc_id = 0 then true else 1000 // doc_id > 3 end"}),
    "p04_arithmetic": ("inv_src", {"quotient": lambda: Q.divided(-c("size"), F.lit(7)), "rest": lambda: Q.strict(-c("size")) % 7, "sum": lambda: c("size") + c("mtime_s") * 2}, {"quotient": "-(size // 7)", "rest": "-(size % 7)", "sum": "size + mtime_s * 2"}),
    "p05_bits": ("inv_dst", {"and_": lambda: c("mode").bitwiseAND(0o200), "xor_": lambda: c("mode").bitwiseXOR(c("doc_id")), "or_": lambda: c("mode").bitwiseOR(1)}, {"and_": "mode & 128", "xor_": "xor(mode, doc_id)", "or_": "mode | 1"}),
    "p06_member": ("inv_src", {"in_": lambda: Q.member(c("link_target"), F.lit("../en"), F.lit(None))}, {"in_": "link_target is null or link_target = '../en'"}),
    "p07_between": ("inv_src", {"in_": lambda: Q.between(c("size"), F.lit(1000), F.lit(3000))}, {"in_": "size between 1000 and 3000"}),
    "p08_glob": ("inv_dst", {"deep": lambda: Q.glob(c("path"), "extra/**.txt"), "flat": lambda: Q.glob(c("path"), "src?/*/1*.txt")}, {"deep": "regexp_full_match(path, 'extra/.*\\.txt')", "flat": "regexp_full_match(path, 'src[^/]/[^/]*/1[^/]*\\.txt')"}),
    "p09_matches": ("inv_src", {"hit": lambda: Q.matches(c("path"), r"/(en|fr)/[0-9]{2}\.")}, {"hit": "regexp_matches(path, '/(en|fr)/[0-9]{2}\\.')"}),
    "p10_strict": ("inv_src", {"size_": lambda: Q.strict(c("size"))}, {"size_": "size"}),
    "p11_if_coalesce": ("inv_src", {"chosen": lambda: F.when(c("doc_id") == 0, 0).otherwise(Q.divided(F.lit(100), c("doc_id"))), "target": lambda: F.coalesce("link_target", "path")}, {"chosen": "case when doc_id = 0 then 0 else 100 // doc_id end", "target": "coalesce(link_target, path)"}),
    "p12_null_tests": ("inv_src", {"none": lambda: c("link_target").isNull(), "some": lambda: c("link_target").isNotNull()}, {"none": "link_target is null", "some": "link_target is not null"}),
    "p13_now": ("inv_src", {"age": lambda: F.lit(1800000000) - c("mtime_s")}, {"age": "1800000000 - mtime_s"}),
}
_ID = {"inv_src": ("path", "doc_id"), "inv_dst": ("path", "doc_id"), "documents": ("doc_id",), "listing": ("bucket", "key", "page_id")}


def _register(name: str, table: str, columns: dict, sql: dict) -> None:
    ids = [i for i in _ID[table] if i not in columns]
    select = ", ".join([*ids, *(f"{v} as {k}" for k, v in sql.items())])
    query(name, f"select {select} from {table}")(lambda t: getattr(t, table).select(*ids, *(f().alias(k) for k, f in columns.items())))


for _name, _of in _SCALARS.items():
    _register(_name, *_of)


@query("f16_mtime_matches", """
select s.path, s.mtime_s = d.mtime_s and (d.mtime_ns = 0 or s.mtime_ns // z = d.mtime_ns // z) as same
from inv_src s join (select *, (10 ^ (length(mtime_ns::varchar) - length(rtrim(mtime_ns::varchar, '0'))))::bigint as z from inv_dst) d using (path)""")  # fmt: skip
def f16(t):
    s, d = t.inv_src.alias("s"), t.inv_dst.alias("d")
    return s.join(d, c("s.path") == c("d.path")).select("s.path", V.mtime_matches(c("s.mtime_s"), c("s.mtime_ns"), c("d.mtime_s"), c("d.mtime_ns")).alias("same"))
