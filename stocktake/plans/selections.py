"""Queries of selection."""

from __future__ import annotations

import asyncio

from pyspark.sql import functions as F

from stocktake.functions import ignore as I
from stocktake.functions import predicates as Q
from stocktake.functions import tiers as N
from stocktake.operators import mapping, prune, rules
from stocktake.operators import selection as S
from stocktake.operators.transform import Context, Mapping

from .registry import query

c = F.col
RULES = ("# ignored parts", "*.tmp", "/src1/", "fr/*7.txt", "!fr/17.txt", "extra/**/de/", "!src1/en/1.txt")
_ABOVE = "list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))"


@query("p14_where", "select path, kind from inv_dst where kind = 'dir' or size > 2500")
def p14(t):
    return S.where(t.inv_dst, c("size") > 2500).select("path", "kind")


@query("p15_where_two_tier", "select page_id, key from listing where case when size < 4000 then false when size > 9000 then true else left(md5(html), 1) < '8' end".replace("from listing", "from listing join pages using (page_id)"))
def p15(t):
    cheap = F.when(c("size") < 4000, False).when(c("size") > 9000, True)
    stored = t.pages.select("page_id", F.md5("html").alias("stored"))
    return S.where_two_tier(t.listing.withColumn("kind", F.lit("file")), cheap, stored, F.substring("stored", 1, 1) < "8", ["page_id"]).select("page_id", "key")


# One predicate over listed and stored facts; owner is stored for two rows in three, and needed only where the size leaves it open.
_STORED = "select page_id, key, size, left(md5(html), 1) as storage, case when page_id % 3 <> 0 then page_id % 7 end as owner from listing join pages using (page_id)"
_HOLDS = "(size > 9000 or storage < '8') and not (size < 3000 and coalesce(owner, 3) = 3) and case when size % 2 = 0 then true else owner is null end"


def _stored_predicate():
    size, owner = N.fact("size"), N.fact("owner")
    large = N.below(9000, size) | N.below(N.fact("storage"), "8")
    even = N.equal(N.call(lambda x: x % 2, size), 0)
    return large & ~(N.below(size, 3000) & N.equal(N.first_of(owner, N.value(3)), 3)) & N.choose(even, True, N.absent(owner))


def _stored(t):
    return t.pages.select("page_id", F.substring(F.md5("html"), 1, 1).alias("storage"), F.when(c("page_id") % 3 != 0, c("page_id") % 7).alias("owner"))


@query("p15_one_predicate", f"select page_id, key from ({_STORED}) where {_HOLDS}")
def p15_one(t):
    return S.where_stored(t.listing.withColumn("kind", F.lit("file")), _stored_predicate(), _stored(t), ["page_id"]).select("page_id", "key")


# Odd sizes need the owner, unless the rest is false already; even ones need the storage class up to 9000 bytes, or the owner below 3000.
@query("p15_undecided", f"select page_id from ({_STORED}) where size % 2 = 1 or size <= 9000")
def p15_undecided(t):
    return N.undecided(t.listing.withColumn("kind", F.lit("file")), _stored_predicate()).select("page_id")


@query("p17_ignore", f"""
with i as (select *, {_ABOVE} as above, list_last(string_split(path, '/')) as name from inv_dst)
select path from i where not (
  case when regexp_matches(path, '(^|/)fr/17\\.txt$') and path like 'fr/%' then false when path = 'src1/en/1.txt' then false when kind = 'dir' and regexp_matches(path, '^extra/(.*/)?de$') then true
    when regexp_matches(path, '^fr/[^/]*7\\.txt$') then true when kind = 'dir' and path = 'src1' then true when name like '%.tmp' then true else false end
  or len(list_filter(above, lambda a: a = 'src1' or regexp_matches(a, '^extra/(.*/)?de$'))) > 0)""")  # fmt: skip
def p17(t):
    return S.without_ignored(t.inv_dst, RULES).select("path")


@query("p18_ignore_selected_file", "select path, regexp_matches(list_last(string_split(path, '/')), '^1.*\\.txt$') and path not like '%/11.txt' as ignored from inv_src")
def p18(t):
    return t.inv_src.select("path", I.ignored_selected(c("path"), ("1*.txt", "!11.txt")).alias("ignored"))


@query("p19_key_pattern", "select bucket, key, page_id from listing where regexp_full_match(key, '[^/]*/.*[0-9]')")
def p19(t):
    return t.listing.filter(Q.key_pattern(c("key"), "*/**") & F.rlike("key", F.lit("[0-9]$"))).select("bucket", "key", "page_id")


_LISTED = "select path from inv_src where doc_id % 6 = 0 union select 'src2' union select 'src3/en'"


def _listed(t):
    return t.inv_src.filter("doc_id % 6 = 0").select("path").union(t.spark.createDataFrame([("src2",), ("src3/en",)], "path string"))


@query("p22_files_from", f"select path from inv_src where path in ({_LISTED})")
def p22(t):
    return S.files_from(t.inv_src, _listed(t)).select("path")


@query("p22_files_from_recursive", f"select path from inv_src where path in ({_LISTED}) or starts_with(path, 'src2/') or starts_with(path, 'src3/en/')")
def p22r(t):
    return S.files_from(t.inv_src, _listed(t), recursive=True).select("path")


@query("p23_typed_selector", """
select s.path, wanted, case when d.kind is null then 'missing' when wanted = 'dir' and d.kind <> 'dir' or wanted = 'file' and d.kind = 'dir' then 'wrong_kind' else 'selected' end as status
from (select path, case when doc_id % 3 = 0 then 'dir' when doc_id % 3 = 1 then 'file' end as wanted from inv_src) s left join inv_dst d using (path)""")  # fmt: skip
def p23(t):
    return S.selected_kinds(t.inv_src.select("path", F.when(c("doc_id") % 3 == 0, "dir").when(c("doc_id") % 3 == 1, "file").alias("wanted")), t.inv_dst)


@query("p23_refused_runs", """
with s as (select path, case when doc_id % 3 = 0 then 'dir' when doc_id % 3 = 1 then 'file' end as wanted, doc_id % 2 as part from inv_src),
x as (select s.path, part, case when d.kind is null then 'missing' when wanted = 'dir' and d.kind <> 'dir' or wanted = 'file' and d.kind = 'dir' then 'wrong_kind' else 'selected' end as status from s left join inv_dst d using (path) where part = 0 or wanted is null)
select path, status, part = 0 and (select count(*) from x where part = 0 and status = 'wrong_kind') > 0 as refused from x""")
def p23_refused(t):
    wanted = F.when(c("doc_id") % 3 == 0, "dir").when(c("doc_id") % 3 == 1, "file")
    part = lambda cond: S.selected_or_refused(t.inv_src.filter(cond).select("path", wanted.alias("wanted")), t.inv_dst)
    return part("doc_id % 2 = 0").union(part("doc_id % 2 = 1 and doc_id % 3 = 2")).select("path", "status", "refused")


@query("p24_clean_partials", "select '.transfer-s3-' || hash || '.partial' as name from inv_src where kind = 'file' and doc_id % 2 = 0")
def p24(t):
    name = F.concat(F.when(c("doc_id") % 2 == 0, ".transfer-s3-").otherwise(".other-s3-"), "hash", F.lit(".partial"))
    return S.partials(t.inv_src.withColumn("path", name)).select(c("path").alias("name"))


@query("p26_delete_excluded", """
with x as (select path, starts_with(path, 'extra/src1/') or path like '%7.txt' as ignored from inv_dst where path not in (select path from inv_src))
select path, 'deleted' as excluded from x union all select path, 'kept' from x where not ignored""")
def p26(t):
    rules = ("/extra/src1/", "*7.txt")
    gone = lambda delete: prune.extras(t.inv_dst, t.inv_src, rules, delete).select("path", F.lit("deleted" if delete else "kept").alias("excluded"))
    return gone(True).union(gone(False))


@query("w01_first_claim", "select key, min(version) as version from versions group by key")
def w01(t):
    return mapping.first_claims(t.versions.select("key", "version"), ["key"], "version")


@query("w17_last_rule_wins", "select path, doc_id % 3 = 0 or (doc_id % 5 = 0 and doc_id % 7 <> 0) as ignored from inv_src")
def w17(t):
    rules = [(c("doc_id") % 5 == 0, True), (c("doc_id") % 7 == 0, False), (c("doc_id") % 3 == 0, True)]
    return t.inv_src.select("path", Q.last_rule_wins(rules).alias("ignored"))


@query("u01_union_of_selectors", "select distinct path from (select path from inv_src where doc_id % 2 = 0 union all select path from inv_src where starts_with(path, 'src1/'))")
def u01(t):
    both = t.inv_src.filter("doc_id % 2 = 0").withColumn("ordinal", F.lit(0)).unionByName(t.inv_src.filter(F.startswith("path", F.lit("src1/"))).withColumn("ordinal", F.lit(1)))
    return mapping.first_claims(both, ["path"], "ordinal").select("path")


@query("u02_versions_and_markers", "select key, version, marker from versions")
def u02(t):
    return t.versions.filter("not marker").unionByName(t.versions.filter("marker"))


@query("x01_mapping_transform", "select src, case when doc_id % 2 = 0 then upper(dst) else dst end as dst from mapping where doc_id % 5 <> 0")
def x01(t):
    change = lambda df: df.filter("doc_id % 5 != 0").withColumn("dst", F.when(c("doc_id") % 2 == 0, F.upper("dst")).otherwise(c("dst")))
    return Mapping(t.mapping.select("src", "dst", "doc_id"), Context("documents")).transform(change).rows.select("src", "dst")


@query("x02_row_transform", "select src, case when doc_id % 3 = 0 then src else dst end as dst, doc_id from mapping where doc_id % 7 <> 0")
def x02(t):
    def entry(row):
        if row["doc_id"] % 7 == 0:
            return None
        return {**row, "dst": row["src"] if row["doc_id"] % 3 == 0 else row["dst"]}

    return Mapping(t.mapping.select("src", "dst", "doc_id"), Context("documents")).map_rows(entry).rows


# Awaited calls, of which every eleventh fails: its entry stays as it came.
@query("x02_async_transform", "select src, case when doc_id % 11 = 5 or doc_id % 3 <> 0 then dst else src end as dst, doc_id, case when doc_id % 11 = 5 then 'ValueError: no ' || doc_id end as error from mapping where doc_id % 7 <> 0 or doc_id % 11 = 5")
def x02_async(t):
    async def entry(row):
        await asyncio.sleep(0.0001)
        if row["doc_id"] % 11 == 5:
            raise ValueError(f"no {row['doc_id']}")
        return None if row["doc_id"] % 7 == 0 else {**row, "dst": row["src"] if row["doc_id"] % 3 == 0 else row["dst"]}

    return Mapping(t.mapping.select("src", "dst", "doc_id"), Context("documents")).map_rows_async(entry).rows


# Rules of many folders: some documents go by name below their source's folder, some of them come back from anywhere, names that end with a digit and 3 go, and one folder with all below it.
@query("p17_rule_table", """
with i as (select *, starts_with(path, 'extra/') as extra from inv_dst)
select path from i where not (
  case when not extra and starts_with(path, 'src1/en/') then true when doc_id % 14 = 0 then false when doc_id >= 10 and doc_id % 10 = 3 then true when not extra and doc_id % 7 = 0 then true else false end)""")
def p17_table(t):
    d = c("doc_id").cast("string")
    names = t.documents.filter("doc_id % 7 = 0").select(c("source").alias("folder"), c("doc_id").alias("ordinal"), F.concat(F.lit("/"), "lang", F.lit("/"), d, F.lit(".txt")).alias("line"))
    again = t.documents.filter("doc_id % 14 = 0").select(F.lit("").alias("folder"), (c("doc_id") + 10**9).alias("ordinal"), F.concat(F.lit("!"), d, F.lit(".txt")).alias("line"))
    tails = t.nation.select(F.lit("").alias("folder"), (c("n_nationkey") + 10**8).alias("ordinal"), F.concat(F.lit("*"), c("n_nationkey").cast("string"), F.lit("3.txt")).alias("line"))
    folder = t.region.filter("r_regionkey = 1").select(F.lit("src1").alias("folder"), F.lit(2 * 10**9).alias("ordinal"), F.lit("en/").alias("line"))
    return rules.without_ignored(t.inv_dst, names.unionAll(again).unionAll(tails).unionAll(folder)).select("path")


@query("x03_same_context", "select src, dst from mapping where doc_id % 5 = 1 union all select src, dst from mapping where doc_id % 5 <> 1")
def x03(t):
    part = lambda cond: Mapping(t.mapping.filter(cond).select("src", "dst"), Context("documents", "store"))
    return part("doc_id % 5 = 1").union(part("doc_id % 5 != 1")).rows


@query("x03_whole_mapping", "select src, dst from mapping where doc_id % 2 = 0 union all select src, dst from mapping where doc_id % 2 <> 0")
def x03_whole(t):
    part = lambda cond: Mapping(t.mapping.filter(cond).select("src", "dst"), Context("documents", "store"))
    return part("doc_id % 2 = 0").union(part("doc_id % 2 != 0")).rows
