"""Queries of outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.operators import outcomes as O
from stocktake.sources import records
from stocktake.sources.scratch import new_folder

from .registry import query

c = F.col


@query("g01_run_totals", """
select run, count(*) filter (disposition = 'transferred') as transferred, count(*) filter (disposition = 'unchanged') as unchanged, count(*) filter (disposition = 'excluded') as excluded, count(*) filter (disposition = 'failed') as failed,
  coalesce(sum(bytes) filter (disposition = 'transferred'), 0)::bigint as bytes_transferred, coalesce(sum(bytes) filter (disposition = 'unchanged'), 0)::bigint as bytes_unchanged from results group by run""")  # fmt: skip
def g01(t):
    return O.run_totals(t.results)


@query("g03_removal_totals", """
select count(*) as selectors, count(*) filter (d.path is not null) as resolved, count(*) filter (d.path is null) as missing,
  (select count(*) from inv_dst where doc_id % 2 = 0) as planned, (select count(*) from inv_dst where doc_id % 2 = 0 and doc_id % 3 <> 0) as removed, (select count(*) from inv_dst where doc_id % 6 = 0 and doc_id % 5 <> 0) as absent, (select count(*) from inv_dst where doc_id % 30 = 0) as failed
from inv_src s left join inv_dst d using (path)""")  # fmt: skip
def g03(t):
    selected = t.inv_src.select(c("path").alias("selector")).join(t.inv_dst.select(c("path").alias("selector"), F.lit(1).alias("here")), "selector", "left").select("selector", F.when(c("here").isNull(), "missing").otherwise("resolved").alias("status"))
    removed = t.inv_dst.filter("doc_id % 2 = 0").select("path", F.when(c("doc_id") % 3 != 0, "removed").when(c("doc_id") % 5 != 0, "already_absent").otherwise("failed").alias("disposition"))
    return O.removal_totals(selected, removed)


@query("g22_errors_counted", "select run, count(*) filter (type = 'error' and diagnostic_for is null) as errors from results group by run")
def g22(t):
    return O.errors_counted(t.results)


@query("a16_run_status", """
select run, status, case status when 'success' then 0 when 'partial' then 23 when 'refused' then 25 when 'aborted' then 1 when 'failed' then 1 else 1 end as exit_code from (
  select run, case when max(status) is null then 'unknown' when max(status) = 'success' and count(*) filter (disposition = 'failed') > 0 then 'partial' else max(status) end as status from results group by run)""")  # fmt: skip
def a16(t):
    return O.run_status(t.results)


@query("w16_sequence_check", """
select run, case when n <> last + 1 then 'gap' when terminals = 0 then 'no_terminal' when terminals > 1 then 'two_terminals' when terminal <> last then 'not_last' else 'ok' end as verdict
from (select run, count(*) as n, max(seq) as last, count(*) filter (type = 'result') as terminals, max(seq) filter (type = 'result') as terminal from results where not (run % 6 = 1 and seq = 2) group by run)""")  # fmt: skip
def w16(t):
    return O.sequence_check(t.results.filter("not (run % 6 = 1 and seq = 2)"))


@query("s08_write_results", "select run, row_number() over (partition by run order by phase, path) - 1 as seq, path from (select run, case type when 'run' then 0 when 'result' then 2 else 1 end as phase, lpad(seq::varchar, 9, '0') as path from results)")
def s08(t):
    phase = F.when(c("type") == "run", 0).when(c("type") == "result", 2).otherwise(1)
    rows = O.numbered(t.results.select("run", phase.alias("phase"), F.lpad(c("seq").cast("string"), 9, "0").alias("path"), "type", "disposition", "dst", "bytes", "status"))
    path = new_folder(t.spark, "results")
    # the path travels as what a diagnostic explains; records are read back from what was written
    records.write_results(rows.withColumn("diagnostic_for", c("path")), path)
    return records.parse_results(t.spark.read.text(path)).filter("error is null or error = 'unknown_status'").select("run", "seq", c("diagnostic_for").alias("path"))


@query("g20_summary_rate", "select run, sum(bytes) / greatest(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0.001) as rate from results group by run")
def g20(t):
    return O.summary_rate(t.results)


_KIND = "case seq % 5 when 0 then 'dir' when 1 then 'symlink' when 2 then 'special' else 'file' end"


@query("g01_result_totals", f"""
select run, count(*) filter (kind = 'file' and disposition = 'transferred') as files_transferred, count(*) filter (kind = 'file' and disposition = 'unchanged') as files_unchanged, count(*) filter (kind = 'file' and disposition = 'excluded') as files_excluded,
  count(*) filter (kind = 'dir' and disposition = 'transferred') as directories_created, count(*) filter (kind = 'symlink' and disposition = 'transferred') as symlinks_created, count(*) filter (kind = 'special' and disposition = 'transferred') as specials_created,
  count(*) filter (type = 'error' and diagnostic_for is null) as errors, coalesce(sum(bytes) filter (kind = 'file' and disposition = 'transferred'), 0)::bigint as bytes_transferred, coalesce(sum(bytes) filter (kind = 'file' and disposition = 'unchanged'), 0)::bigint as bytes_unchanged
from (select *, {_KIND} as kind from results) group by run""")  # fmt: skip
def g01_totals(t):
    n = c("seq") % 5
    return O.result_totals(t.results.withColumn("kind", F.when(n == 0, "dir").when(n == 1, "symlink").when(n == 2, "special").otherwise("file")))
