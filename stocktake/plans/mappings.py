"""Queries of mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.functions.paths import path_error
from stocktake.operators import mapping as M
from stocktake.operators import prefixes
from stocktake.operators.ordering import numbered

from .registry import query

c = F.col
_UP = "list_transform(range(1, len(string_split(dst, '/'))), lambda i: array_to_string(string_split(dst, '/')[1:i], '/'))"


@query("j02_apply_mapping", """select src, dst, case when s.kind is null or m.kind <> s.kind then 'failed' else 'planned' end as status, case when s.kind is null then 'not_found' when m.kind <> s.kind then 'conflict' end as class, size
from mapping m left join inv_src s on m.src = s.path""".replace("select src, dst", "select m.src, m.dst"))  # fmt: skip
def j02(t):
    return M.apply(t.mapping, t.inv_src)


@query("g06_duplicate_destinations", "select dst, count(*) as n from mapping group by dst having count(*) > 1")
def g06(t):
    return M.duplicate_destinations(t.mapping)


@query("g07_ancestor_kind_conflicts", f"select distinct m.dst, m.above from (select dst, unnest({_UP}) as above from mapping) m join mapping k on k.dst = m.above and k.kind is distinct from 'dir'")
def g07(t):
    return M.ancestor_conflicts(t.mapping)


@query("g08_implicit_directories", f"select distinct path from (select unnest({_UP}) as path from mapping) where path not in (select dst from mapping where kind = 'dir')")
def g08(t):
    return M.implicit_directories(t.mapping)


@query("u05_implicit_parents", f"select distinct unnest({_UP}) as path from mapping")
def u05(t):
    return prefixes.ancestors_of(t.mapping.select(c("dst").alias("path")))


@query("o01_parents_first", "select row_number() over (order by string_split(path, '/')) as nth, path from inv_dst")
def o01(t):
    return numbered(t.inv_dst, M.parents_first()).select("nth", "path")


@query("f08_mapping_errors", "select dst, null::varchar as error from mapping")
def f08m(t):
    return t.mapping.select("dst", path_error(c("dst")).alias("error"))


@query("j15_retry_manifest", """
select r.run, r.dst, m.src, m.hash from (select distinct run, dst from results where disposition = 'failed' and coalesce(retryable, '') <> 'no' and run in (select run from results where type = 'result' and status in ('success', 'partial'))) r
join (select path as src, hash, 'f/' || doc_id as dst from inv_src) m using (dst)""")  # fmt: skip
def j15(t):
    mapping = t.inv_src.select(c("path").alias("src"), "hash", F.concat(F.lit("f/"), c("doc_id").cast("string")).alias("dst"))
    return M.retry_manifest(t.results, mapping).select("run", "dst", "src", "hash")


_CLAIMS = """select case when doc_id % 10 < 4 then 'd' || doc_id // 20 else dst end as dst, case when doc_id % 10 in (0, 1) then 'dir' when doc_id % 40 in (2, 12) then 'weak' when doc_id % 40 = 22 then 'file' when doc_id % 10 < 4 then 'weak' else 'file' end as claim, doc_id, mode, mtime from mapping"""


def _claims(t):
    d = c("doc_id")
    dst = F.when(d % 10 < 4, F.concat(F.lit("d"), F.floor(d / 20).cast("string"))).otherwise(c("dst"))
    claim = F.when((d % 10).isin(0, 1), "dir").when((d % 40).isin(2, 12), "weak").when(d % 40 == 22, "file").when(d % 10 < 4, "weak").otherwise("file")
    return t.mapping.select(dst.alias("dst"), claim.alias("claim"), "doc_id", "mode", "mtime")


@query("w02_claim_resolution", f"""
select dst, case when d > 0 and f > 0 then 'refused' when f > 1 then 'contested' when f = 1 then 'file' when d > 0 then 'dir' else 'weak' end as outcome
from (select dst, count(*) filter (claim = 'dir') as d, count(*) filter (claim = 'file') as f from ({_CLAIMS}) group by dst)""")  # fmt: skip
def w02(t):
    return M.claim_resolution(_claims(t))


@query("w18_merge_directory_attributes", f"select dst, arg_max(mode, doc_id) filter (mode is not null) as mode, arg_max(mtime, doc_id) filter (mtime is not null) as mtime from ({_CLAIMS}) group by dst")
def w18(t):
    return M.merged_attributes(_claims(t), ["mode", "mtime"], "doc_id")
