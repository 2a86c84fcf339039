"""Queries of pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.operators import prefixes, prune
from stocktake.operators.ordering import numbered

from .registry import query

c = F.col
_CAND = "select * from inv_dst where path not in (select path from inv_src)"
_UP = "list_transform(range(1, len(string_split({0}, '/'))), lambda i: array_to_string(string_split({0}, '/')[1:i], '/'))"


def _candidates(t):
    return prune.candidates(t.inv_dst, t.inv_src)


@query("j04_prune_candidates", f"select path, kind from ({_CAND})")
def j04(t):
    return _candidates(t).select("path", "kind")


def _claims(t):
    return t.inv_src.filter("doc_id % 3 != 0").select(F.concat("path", F.lit("/part")).alias("path"))


@query("j05_claim_ancestors", "select path from inv_dst where path not in (select path from inv_src where doc_id % 3 <> 0)")
def j05(t):
    return prune.without_claim_ancestors(t.inv_dst, _claims(t)).select("path")


def _protected(t):
    return t.spark.createDataFrame([("extra/src1",), ("src2",), ("src3/en/3.txt",), ("src",)], "path string")


_SHIELD = "starts_with(path, 'extra/src1/') or path = 'extra/src1' or starts_with(path, 'src2/') or path = 'src2' or path = 'src3/en/3.txt' or starts_with(path, 'src3/en/3.txt/')"


@query("j06_shielded", f"select path from inv_dst where not ({_SHIELD})")
def j06(t):
    return prune.unshielded(t.inv_dst, _protected(t)).select("path")


@query("j07_beneath", f"select path from inv_dst where {_SHIELD}")
def j07(t):
    return prefixes.beneath(t.inv_dst, _protected(t)).select("path")


@query("j08_scope_of", "select path, case when starts_with(path, 'extra/src1/en/') then 'extra/src1/en' when starts_with(path, 'extra/') then 'extra' when starts_with(path, 'src1/') then 'src1' end as scope from inv_dst")
def j08(t):
    return prefixes.scope_of(t.inv_dst, t.spark.createDataFrame([("extra",), ("extra/src1/en",), ("src1",)], "path string"))


@query("j09_alias_guard", f"""
with a as (select path from ({_CAND}) where inode in (select inode from inv_src where doc_id % 2 = 0))
select path from ({_CAND}) where path not in (select path from a) and not exists (select 1 from a where starts_with(a.path, inv.path || '/'))""".replace(f"from ({_CAND}) where path not", f"from ({_CAND}) inv where path not"))  # fmt: skip
def j09(t):
    return prune.without_aliases(_candidates(t), t.inv_src.filter("doc_id % 2 = 0").withColumn("device", F.lit(2).cast("long"))).select("path")


@query("j10_sources_overlap", "select a.path as a, b.path as b from inv_src a join (select case when doc_id % 4 = 0 then path when doc_id % 4 = 1 then path || '/x' else 'z/' || path end as path from inv_src) b on a.path = b.path or starts_with(b.path, a.path || '/')")
def j10(t):
    other = F.when(c("doc_id") % 4 == 0, c("path")).when(c("doc_id") % 4 == 1, F.concat("path", F.lit("/x"))).otherwise(F.concat(F.lit("z/"), "path"))
    return prefixes.overlap(t.inv_src, t.inv_src.select(other.alias("path")))


@query("j18_holds_kept", f"""
select path, min(reason) as reason from (select unnest({_UP.format('path')}) as path, case when doc_id % 2 = 0 then 'ignored' else 'partial' end as reason from inv_dst where doc_id % 6 < 2)
where path in (select unnest({_UP.format('path')}) from inv_dst) group by path""")  # fmt: skip
def j18(t):
    kept = t.inv_dst.filter("doc_id % 6 < 2").select("path", F.when(c("doc_id") % 2 == 0, "ignored").otherwise("partial").alias("reason"))
    return prune.kept_directories(prefixes.ancestors_of(t.inv_dst), kept)


@query("g04_delete_cap", f"select path, case when (select count(*) from ({_CAND})) > 50 then 'blocked' else 'planned' end as disposition from ({_CAND})")
def g04(t):
    return prune.delete_cap(_candidates(t), 50).select("path", "disposition")


@query("g05_prune_gate", f"select path, case when (select count(*) from results where type = 'error') > 0 then 'blocked' else 'planned' end as disposition from ({_CAND})")
def g05(t):
    return prune.gated(_candidates(t), t.results.filter("type = 'error'")).select("path", "disposition")


_STOPPED = "select run from results where type = 'error'"


def _gated(t):
    """Candidates of runs without any error; a candidate belongs to the run of its doc_id."""
    return prune.prune_gate_by(_candidates(t).withColumn("run", c("doc_id")), t.results.filter("type = 'error'"), "run")


@query("g05_prune_gate_of_runs", f"select path, doc_id as run from ({_CAND}) where doc_id not in ({_STOPPED})")
def g05_runs(t):
    return _gated(t).select("path", "run")


@query("o02_deletion_order", f"select row_number() over (order by kind = 'dir', len(string_split(path, '/')) desc, path) as nth, path from ({_CAND})")
def o02(t):
    return numbered(_candidates(t), prune.deletion_order()).select("nth", "path")


@query("o04_request_batches", f"select path, (row_number() over (partition by kind order by path) - 1) // 20 as batch from ({_CAND})")
def o04(t):
    return prune.request_batches(_candidates(t), "kind", 20).select("path", c("batch").cast("long").alias("batch"))


@query("o08_prune_around_copy", f"""
select path, 'before' as phase from ({_CAND}) where doc_id % 2 = 0 and doc_id not in ({_STOPPED} and seq < 5)
union all select path, 'after' from ({_CAND}) where doc_id % 2 = 1 and doc_id not in ({_STOPPED})""")
def o08(t):
    gone, errors = _candidates(t).withColumn("run", c("doc_id")), t.results.filter("type = 'error'")
    return prune.around_copy(gone.filter("doc_id % 2 = 0"), gone.filter("doc_id % 2 = 1"), errors.filter("seq < 5"), errors, "run").select("path", "phase")


@query("o08_gate_around_copy", f"select path, case when doc_id % 2 = 0 then 'before' else 'after' end as phase from ({_CAND}) where doc_id not in ({_STOPPED})")
def o08_gate(t):
    gone = _gated(t)
    return gone.filter("doc_id % 2 = 0").select("path", F.lit("before").alias("phase")).union(gone.filter("doc_id % 2 = 1").select("path", F.lit("after").alias("phase")))


@query("u03_except_claims", f"select path, size from ({_CAND})")
def u03(t):
    return t.inv_dst.join(t.inv_src.select("path"), "path", "left_anti").select("path", "size")


@query("u04_claimed_identities", "select path from inv_dst where inode in (select inode from inv_src where doc_id % 4 = 1)")
def u04(t):
    return t.inv_dst.join(t.inv_src.filter("doc_id % 4 = 1").select("inode").distinct(), "inode", "left_semi").select("path")


@query("w15_spread_by_parent", "select path, (row_number() over (partition by regexp_replace(path, '/[^/]*$', '') order by path) - 1) // 4 as turn from inv_dst")
def w15(t):
    return prune.spread_by_parent(t.inv_dst, 4).select("path", c("turn").cast("long").alias("turn"))
