"""Queries of reconciliation: joins and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.operators import content, mapping as M, outcomes, reconcile as R
from stocktake.operators.balance import balanced
from stocktake.operators.ordering import numbered

from .registry import query

c = F.col

_PAIRS = """
with p as (
  select coalesce(s.path, d.path) as path, s.path as sp, d.path as dp, s.kind as sk, d.kind as dk, s.size as ss, d.size as ds, s.mtime_s as sm, d.mtime_s as dm, s.mtime_ns as sn, d.mtime_ns as dn, s.mode as smode, d.mode as dmode,
    s.uid as su, d.uid as du, s.hash as sh, d.hash as dh, s.device as sd, d.device as dd, s.inode as si, d.inode as di, s.link_target as sl, d.link_target as dl,
    coalesce(s.device = d.device and s.inode = d.inode, false) as same_file, (d.mtime_s, d.mtime_ns) > (s.mtime_s, s.mtime_ns) as newer,
    case when s.path is null then 'destination_only' when d.path is null then 'destination_missing' when s.kind <> d.kind then 'type_differs' else 'content_differs' end as why,
    coalesce(s.kind = 'file' and d.kind = 'file' and s.size = d.size and s.mtime_s = d.mtime_s and (d.mtime_ns = 0 or s.mtime_ns // z = d.mtime_ns // z), false) as quick,
    coalesce(s.kind = 'file' and d.kind = 'file' and s.size = d.size and s.hash = d.hash, false) as same_hash
  from inv_src s full join (select *, (10 ^ (length(mtime_ns::varchar) - length(rtrim(mtime_ns::varchar, '0'))))::bigint as z from inv_dst) d using (path)
)"""


def _decide(policy: str, same: str = "quick", attrs: str = "smode <> dmode", low: int | None = None, permitted: str = "true", contested: str = "false") -> str:
    lines = [("sp is null", "none", "extra", "'destination_only'"), (f"not ({permitted})", "none", "excluded", "'predicate'")]
    lines += [("same_file", "none", "failed", "'exists'")] if policy == "error" else [("same_file", "none", "excluded", "'same_file'")]
    lines += [(contested, "none", "failed", "'contested'")]
    lines += [(f"ss < {low}", "none", "excluded", "'size'")] if low else []
    lines += [("dp is not null", "none", "excluded", "'exists'")] if policy == "keep" else []
    lines += [("dk = 'dir'", "none", "failed", "'directory_in_place'")]
    lines += [("dp is not null", "none", "failed", "'exists'")] if policy == "error" else []
    lines += [("dp is not null and (dk <> 'file' or ss <> ds)", "none", "failed", "'differs'")] if policy == "error-if-different" else []
    lines += [("dp is not null and newer", "none", "excluded", "'newer'")] if policy == "update-if-older" else []
    lines += [(f"{same} and {attrs}", "set_attributes", "unchanged", "'metadata_differs'"), (same, "none", "unchanged", "'equal'"), ("true", "transfer_file", "planned", "why")]
    case = lambda i: "case " + " ".join(f"when {x[0]} then " + (x[i] if i == 3 else f"'{x[i]}'") for x in lines) + " end"
    return f"{_PAIRS} select path, {case(1)} as action, {case(2)} as disposition, {case(3)} as reason, case when {case(1)} = 'transfer_file' then ss else 0 end as bytes from p where sp is null or sk = 'file'"


def _pairs(t):
    return R.pairs(t.inv_src, t.inv_dst)


def _contested(t):
    """Pairs with the outcome of the claims on their path; a second source claims some of the paths."""
    claims = t.inv_src.select(c("path").alias("dst"), F.lit("file").alias("claim"))
    outcomes_ = M.claim_resolution(claims.union(t.inv_src.filter("doc_id % 12 < 2").select("path", F.lit("file"))))
    return _pairs(t).join(outcomes_.select(c("dst").alias("__at"), "outcome"), c("path") == c("__at"), "left").drop("__at")


@query("a01_decide_file", _decide("update"))
def reconcile_plan(t):
    return R.decide_files(_pairs(t))


for _policy in R.POLICIES[1:]:
    query(f"a02_policy_{_policy.replace('-', '_')}", _decide(_policy))(lambda t, p=_policy: R.decide_files(_pairs(t), p))

query("p16_copy_if", _decide("update", permitted="coalesce(ss > 1000 and coalesce(dm < 1700030000, true), false)"))(
    lambda t: R.decide_files(_pairs(t), permitted=F.coalesce((c("src.size") > 1000) & F.coalesce(c("dst.mtime_s") < 1700030000, F.lit(True)), F.lit(False)))
)
query("p20_size_range", _decide("update", low=2000))(lambda t: R.decide_files(_pairs(t), low=2000))
query("p21_keep_existing", _decide("keep"))(lambda t: R.decide_files(_pairs(t), "keep"))
query("p21_only_existing", f"{_PAIRS} select path, why from p where sp is not null and dp is not null")(lambda t: R.only_existing(_pairs(t)).select("path", R.trace_reason(F.lit(True)).alias("why")))
query("p25_policy_stage_order", _decide("keep", low=500, permitted="ss > 1000"))(lambda t: R.decide_files(_pairs(t), "keep", low=500, permitted=c("src.size") > 1000))
query("p25_permission_before_errors", _decide("error", low=500, permitted="ss > 1000"))(lambda t: R.decide_files(_pairs(t), "error", low=500, permitted=c("src.size") > 1000))
query("a01_contested", _decide("update", contested="path in (select path from inv_src where doc_id % 12 < 2)"))(lambda t: R.decide_files(_contested(t), contested=F.coalesce(c("outcome") == "contested", F.lit(False))))
query("a01_other_host", _decide("update").replace("s.device = d.device and s.inode = d.inode", "false"))(lambda t: R.decide_files(_pairs(t), same_host=False))
query("a05_hash_unchanged", _decide("update", same="same_hash"))(lambda t: R.decide_files(_pairs(t), unchanged=R.hash_unchanged()))


@query("j01_reconcile", f"{_PAIRS} select path, ss as src_size, ds as dst_size, sp is not null as has_src, dp is not null as has_dst from p")
def j01(t):
    return _pairs(t).select("path", c("src.size").alias("src_size"), c("dst.size").alias("dst_size"), c("src").isNotNull().alias("has_src"), c("dst").isNotNull().alias("has_dst"))


@query("j03_same_file", f"{_PAIRS} select path from p where same_file")
def j03(t):
    return _pairs(t).filter(R.same_file()).select("path")


@query("a03_trace_reason", f"{_PAIRS} select path, why as reason from p")
def a03(t):
    return _pairs(t).select("path", R.trace_reason(F.lit(True)).alias("reason"))


@query("a04_quick_unchanged", f"{_PAIRS} select path, quick from p")
def a04(t):
    return _pairs(t).select("path", R.quick_unchanged().alias("quick"))


@query("a06_changed_attributes", f"""{_PAIRS} select path, array_to_string(list_filter([case when smode is distinct from dmode then 'mode' end, case when su is distinct from du then 'uid' end,
  case when sm is distinct from dm or sn is distinct from dn then 'mtime' end], lambda x: x is not null), ',') as changed from p where sp is not null and dp is not null""")  # fmt: skip
def a06(t):
    return _pairs(t).filter("src is not null and dst is not null").select("path", F.array_join(R.changed_attributes(("mode", "uid", "mtime")), ",").alias("changed"))


A07 = f"""{_PAIRS} select path, case when dk = 'dir' then 'refuse' when sk = dk and sl is not distinct from dl then 'unchanged' when sk = 'symlink' then 'create_link' else 'create_special' end as action, why as reason
from p where sk not in ('file', 'dir')"""


@query("a07_decide_link_or_special", A07)
def a07(t):
    return R.decide_links(_pairs(t))


A08 = """
with w as (select distinct unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as path from inv_src
  union select distinct path || '/x' from inv_dst where doc_id % 14 = 1 union select distinct path from inv_dst where doc_id % 14 = 1),
f as (select w.path, case when d.path is null then 'create' when d.kind = 'dir' then 'exists' else 'conflict' end as action from w left join inv_dst d using (path))
select f.path, case when exists (select 1 from f g where g.action = 'conflict' and starts_with(f.path, g.path || '/')) then 'skipped' else action end as action from f"""


@query("p16_directories", f"select path, action, action in ('create', 'exists') and length(path) % 2 = 0 as attributes from ({A08})")
def p16_directories(t):
    return R.directory_attributes(a08(t), F.length("path") % 2 == 0)


@query("a08_decide_directory", A08)
def a08(t):
    from stocktake.operators.prefixes import ancestors_of

    some = t.inv_dst.filter("doc_id % 14 = 1").select("path")
    wanted = ancestors_of(t.inv_src).union(some).union(some.select(F.concat("path", F.lit("/x")))).distinct()
    return R.decide_directories(wanted, t.inv_dst)


@query("a13_mapping_attributes", """
select m.dst, coalesce(m.mode, s.mode) as mode, coalesce(m.mtime, s.mtime_s) as mtime_s, m.mtime is null as quick_allowed, case when s.kind = 'symlink' and m.mode is not null then 'mode_on_link' end as error
from mapping m join inv_src s on m.src = s.path""")  # fmt: skip
def a13(t):
    return R.mapping_attributes(t.mapping, t.inv_src).drop("uid", "gid")


@query("a13_owner_overrides", "select m.dst, case when m.doc_id % 5 = 0 then 7 else s.uid end as uid, case when m.doc_id % 7 = 0 then 8 else s.gid end as gid from mapping m join inv_src s on m.src = s.path")
def a13_owners(t):
    d = c("doc_id")
    over = t.mapping.withColumns({"uid": F.when(d % 5 == 0, F.lit(7).cast("long")), "gid": F.when(d % 7 == 0, F.lit(8).cast("long"))})
    return R.mapping_attributes(over, t.inv_src).select("dst", "uid", "gid")


@query("a14_capacity_check", "select sum(b)::bigint as bytes, count(*) as inodes, sum(b) <= 100000000 and count(*) + 64 <= 5000 as fits from (select device, inode, max(nth * 100) as b from hardlinks group by device, inode)")
def a14(t):
    return R.capacity(t.hardlinks.withColumn("bytes", (c("nth") * 100).cast("long")), 100000000, 5000)


@query("a15_placement_condition", "select s.path, case when d.path is null then 'new' else 'existing' end as placement from inv_src s left join inv_dst d using (path)")
def a15(t):
    return R.placements(_pairs(t)).select("path", "placement")


@query("a15_required_placement", "select s.path, case when d.path is not null then 'target_is_existing' end as error from inv_src s left join inv_dst d using (path)")
def a15_required(t):
    return R.placements(_pairs(t), "new").select("path", "error")


_PLAN = _decide("update")


@query("g02_dry_run_summary", f"""select category, count(*) as n, sum(bytes)::bigint as bytes from (select *, case when action = 'none' then 'nothing' when reason = 'type_differs' then 'replaced' when action = 'set_attributes' then 'attributes'
when reason = 'destination_missing' then 'new' else 'changed' end as category from ({_PLAN})) group by category""")  # fmt: skip
def g02(t):
    return outcomes.dry_run_summary(reconcile_plan(t))


_LINKS = "select 'symlink' as kind, action, reason from ({})"


@query("g02_dry_run_changes", f"""
with plan as (select 'file' as kind, action, reason from ({_PLAN}) union all select * from ({_LINKS.format(A07)}))
select count(*) filter (action = 'transfer_file') as regular_files, count(*) filter (action = 'create') as directories, count(*) filter (action = 'create_link') as symlinks, count(*) filter (action = 'create_special') as specials, count(*) filter (action = 'set_attributes') as metadata_only,
  count(*) filter (reason = 'type_differs' and action in ('transfer_file', 'create', 'create_link', 'create_special')) as type_replacements from plan""")
def g02_changes(t):
    plan = reconcile_plan(t).select(F.lit("file").alias("kind"), "action", "reason").union(a07(t).select(F.lit("symlink"), "action", "reason"))
    return outcomes.dry_run_changes(plan)


@query("a07_device_numbers", f"{_PAIRS} select path, case when dk = 'dir' then 'refuse' when sk = dk and (select doc_id from inv_src i where i.path = p.path) % 2 = 0 then 'unchanged' else 'create_special' end as action from p where sk = 'fifo'")
def a07_devices(t):
    as_device = lambda df, rdev: df.filter("kind in ('fifo', 'dir')").withColumns({"kind": F.when(c("kind") == "fifo", "block").otherwise(c("kind")), "rdev": rdev})
    of = R.pairs(as_device(t.inv_src, c("doc_id")), as_device(t.inv_dst, c("doc_id") + c("doc_id") % 2))
    return R.decide_links(of).select("path", "action")


@query("g21_replaced_not_in_place", f"select reason, count(*) as n from ({_PLAN}) where action = 'transfer_file' and reason <> 'destination_missing' group by reason")
def g21(t):
    return R.replaced_not_in_place(reconcile_plan(t))


@query("o07_largest_first", f"select row_number() over (order by bytes desc) as size_rank, bytes from ({_PLAN}) where action = 'transfer_file'")
def o07(t):
    return numbered(reconcile_plan(t).filter("action = 'transfer_file'"), [F.desc("bytes"), F.xxhash64("path")], "size_rank").select("size_rank", "bytes")


@query("o07_whole_order", f"select row_number() over (order by bytes desc, md5(path), path) as nth, path, bytes from ({_PLAN}) where action = 'transfer_file'")
def o07_whole(t):
    return numbered(reconcile_plan(t).filter("action = 'transfer_file'"), [F.desc("bytes"), F.md5("path"), c("path")]).select("nth", "path", "bytes")


# Of 8 partitions; rows of more than 1/64 of all cost are dealt one by one, and the others fill the room that is left.
@query("o07_balanced_partitions", f"""
with plan as (select path, bytes, bytes + 1024 as cost, reverse(lpad(bin(row_number() over (order by path) - 1), 44, '0')) as key from ({_PLAN}) where action = 'transfer_file'),
rows as (select *, cost * 64 > (select sum(cost) from plan) as heavy from plan),
alone as (select *, row_number() over (order by cost desc, key) as k from rows where heavy),
dealt as (
  select 0::bigint as k, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[] as loads, 0 as slot
  union all select a.k, list_transform(d.loads, lambda x, i: x + case when i = list_position(d.loads, list_min(d.loads)) then a.cost else 0 end), list_position(d.loads, list_min(d.loads)) from dealt d join alone a on a.k = d.k + 1),
full_ as (select loads, list_sort(loads) as ordered, (select sum(cost) from rows) - list_sum(loads) as rest from dealt where k = (select count(*) from alone)),
levels as (select n, loads, (rest + list_sum(ordered[1:n]) + n - 1) // n as level, ordered[n + 1] as above from full_, (select unnest(range(1, 9)) as n)),
level_ as (select loads, level from levels where above is null or level <= above order by n limit 1),
ends as (select list_transform(range(1, 9), lambda i: list_sum(list_transform(loads[1:i], lambda x: greatest(0, level - x)))) as ends from level_),
filled as (select *, sum(case when heavy then 0 else cost end) over (order by key) - cost as start from rows),
chosen as (select path, bytes, cost, key, case when heavy then (select slot - 1 from dealt d join alone a on d.k = a.k where a.key = f.key) else least(7, len(list_filter(ends, lambda x: x <= start))) end::int as partition from filled f, ends)
select path, bytes, partition, row_number() over (partition by partition order by cost desc, key) as turn from chosen""")
def o07_balanced(t):
    plan = reconcile_plan(t).filter("action = 'transfer_file'").select("path", c("bytes").cast("long").alias("bytes"))
    return balanced(plan, 8, "path", "bytes", per_file=1024)


@query("j13_verify_expected", """select d.path, case when m.src is null then 'unexpected' when m.hash = d.hash then 'ok' else 'mismatch' end as "check" from inv_dst d left join mapping m on m.src = d.path""")
def j13(t):
    return content.verify_expected(t.inv_dst, t.mapping.select(c("src").alias("path"), F.upper("hash").alias("hash")), "path")
