"""Queries of streams: each runs over what is there and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocktake.operators import reconcile
from stocktake.sources import records
from stocktake.sources.scratch import new_folder, settle
from stocktake.streaming import logs, reconciling

from .reconciles import _PLAN as PLAN
from .registry import query

c = F.col


def _stream(t, df, label):
    path = new_folder(t.spark, label)
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).parquet(path)


def _requests(t):
    return _stream(t, t.download_events.withColumn("ts", c("ts").cast("timestamp")), "requests")


def _lines(t):
    path = new_folder(t.spark, "lines")
    records.result_lines(t.results).write.text(path)
    return path


@query("t01_tail_results", "select run, seq, type from results")
def t01(t):
    return logs.drained(logs.tail_results(t.spark, _lines(t)).select("run", "seq", "type"), "tail")


@query("t02_latest_progress", "select run, max(seq) as seq, arg_max(bytes, seq) as bytes from results group by run")
def t02(t):
    return logs.drained(logs.latest_progress(logs.tail_results(t.spark, _lines(t))), "progress", "complete")


@query("t03_run_completion", "select run, count(*) as records, count(*) filter (disposition = 'failed' or type = 'error') as errors, coalesce(max(status), 'unknown') as status from results group by run")
def t03(t):
    updates = logs.drained(logs.run_completion(logs.tail_results(t.spark, _lines(t))), "completion", "update")
    last = updates.groupBy("run").agg(F.max_by(F.struct("records", "errors", "status"), "batch").alias("r"))
    return last.select("run", "r.*")


@query("t04_live_daily_installs", "select day, case when asset = 'tool-linux-x64.gz' then 'archive' else 'binary' end as kind, count(*) as downloads from download_events where asset in ('tool-linux-x64.gz', 'tool-macos-arm64') group by all")
def t04(t):
    return logs.drained(logs.live_installs(_requests(t)), "installs", "complete")


@query("t05_install_sessions", """
with e as (select ts, ip, case when target_header is not null then target_header when starts_with(asset, 'tool-linux-x64') then 'linux-x64' when starts_with(asset, 'tool-macos-arm64') then 'macos-arm64' end as target from download_events),
m as (select *, case when ts < lag(ts) over w + interval 5 minutes then 0 else 1 end as new from e window w as (partition by ip, target order by ts)),
s as (select *, sum(new) over (partition by ip, target order by ts rows unbounded preceding) as nth from m)
select epoch_us(min(ts)) as start_us, ip, target, count(*) as requests from s group by ip, target, nth""")  # fmt: skip
def t05(t):
    return logs.drained(logs.install_sessions(_requests(t)), "sessions", "complete")


@query("t06_rate_windows", "select epoch_us(start) as start_us, avg(value) as rate, count(*) as n from (select value, unnest([b - to_microseconds(2500000 * i) for i in range(4)]) as start, ts from (select *, time_bucket(interval '2500 milliseconds', ts, timestamp '1970-01-01') as b from events)) group by start")
def t06(t):
    return logs.drained(logs.rate_windows(_stream(t, t.events.select(c("ts").cast("timestamp").alias("ts"), "value"), "rates")), "windows", "complete")


@query("t04_live_daily_checks", "select day, count(*) as checks from download_events where asset = 'tool-release-manifest.json' and latest = 1 and purpose_header = 'check' group by day")
def t04_checks(t):
    return logs.drained(logs.live_checks(_requests(t)), "checks", "complete")


@query("t07_incremental_reconcile", f"select path from ({PLAN}) where action = 'transfer_file'")
def t07(t):
    out = new_folder(t.spark, "plans")
    dst = settle(t.inv_dst, "state")

    def each(batch, number):
        plan = reconcile.decide_files(reconcile.pairs(batch, dst)).filter("action = 'transfer_file'").select("path")
        plan.write.mode("overwrite").parquet(f"{out}/{number}")

    logs.drained(_stream(t, t.inv_src, "snapshots"), "reconcile", each=each)
    return t.spark.read.option("recursiveFileLookup", True).schema("path string").parquet(out)


# The source is listed twice; meanwhile every sixth file grows and every eighth goes. The second listing meets the result of the first, across a restart.
@query("t07_listed_again", """
with one as (
  select s.path, 1::bigint as snapshot, case when d.path is not null and s.kind = d.kind and s.size = d.size and s.mtime_s = d.mtime_s and d.mtime_ns in (0, s.mtime_ns) then 'none' else 'transfer' end as action,
    case when d.path is null then 'destination_missing' when s.kind <> d.kind then 'type_differs' when s.size = d.size and s.mtime_s = d.mtime_s and d.mtime_ns in (0, s.mtime_ns) then 'unchanged' else 'content_differs' end as reason, s.size
  from inv_src s left join inv_dst d using (path)),
two as (
  select path, 2::bigint as snapshot, case when doc_id % 8 = 1 then 'remove' when doc_id % 6 = 0 then 'transfer' else 'none' end as action,
    case when doc_id % 8 = 1 then 'source_gone' when doc_id % 6 = 0 then 'content_differs' else 'unchanged' end as reason, size + 1 as size from inv_src)
select path, snapshot, action, reason, case when action = 'transfer' then size end as bytes from (select * from one union all select * from two)""")
def t07_again(t):
    folder = new_folder(t.spark, "listings")
    entry = ["path", "kind", "size", "mtime_s", "mtime_ns"]
    d = c("doc_id")
    first = t.inv_src.select(F.lit(1).cast("long").alias("snapshot"), *entry)
    second = t.inv_src.withColumns({"kind": F.when(d % 8 != 1, c("kind")), "size": c("size") + (d % 6 == 0).cast("int")}).select(F.lit(2).cast("long").alias("snapshot"), *entry)
    for listing in (first, second):
        listing.write.mode("append").parquet(f"{folder}/rows")
        stream = t.spark.readStream.schema(first.schema).parquet(f"{folder}/rows")
        reconciling.planned(stream, f"{folder}/plan", f"{folder}/log", t.inv_dst.select(*entry))
    return reconciling.plans(t.spark, f"{folder}/plan")


@query("t08_dedupe_events", "select run, seq, type from results")
def t08(t):
    twice = t.results.select("run", "seq", "type", c("ts").cast("timestamp").alias("ts"))
    return logs.drained(logs.once_each(_stream(t, twice.union(twice), "twice"), ["run", "seq"]), "once").select("run", "seq", "type")


@query("x06_event_callback", "select count(*) as records from results")
def x06(t):
    out = new_folder(t.spark, "callback")
    logs.drained(logs.tail_results(t.spark, _lines(t)), "callback", each=lambda batch, number: batch.agg(F.count("*").alias("records")).write.mode("overwrite").parquet(f"{out}/{number}"))
    return t.spark.read.option("recursiveFileLookup", True).schema("records long").parquet(out).agg(F.sum("records").alias("records"))
