"""Queries of performance evidence and download logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stocktake.operators import evidence as E

from .registry import query

c = F.col


def _sockets(t):
    e = c("event_id")
    return t.events.select("user_id", (e * 1000).alias("bytes_sent"), F.when(e % 97 != 0, e * 10).alias("bytes_retransmitted"), F.when(e % 83 != 0, e % 500).alias("rtt_us"), F.when(e % 89 != 0, e % 700).alias("busy_us"), (e % 300).alias("limited_us"))


@query("g12_tcp_totals", """
select user_id, case when count(s) = count(*) then sum(s)::bigint end as bytes_sent, case when count(r) = count(*) then sum(r)::bigint end as bytes_retransmitted, case when count(r) = count(*) then 100.0 * sum(r) / nullif(sum(s), 0) end as loss_percent,
  case when count(u) = count(*) then min(u) end as rtt_min_us, case when count(u) = count(*) then (sum(u) // count(*))::bigint end as rtt_avg_us, case when count(b) = count(*) and sum(b) > 0 then 100.0 * sum(l) / sum(b) end as limited_percent
from (select user_id, event_id * 1000 as s, case when event_id % 97 <> 0 then event_id * 10 end as r, case when event_id % 83 <> 0 then event_id % 500 end as u, case when event_id % 89 <> 0 then event_id % 700 end as b, event_id % 300 as l from events) group by user_id""")  # fmt: skip
def g12(t):
    return E.tcp_totals(_sockets(t), ["user_id"])


@query("g13_worker_shares", "select user_id, state, sum(ns)::bigint as time_ns, sum(ns) / sum(sum(ns)) over (partition by user_id) as share from (select user_id, ['read', 'write', 'parked'][event_id % 3 + 1] as state, event_id + 1 as ns from events) where state <> 'parked' group by user_id, state")
def g13(t):
    state = F.element_at(F.array(F.lit("read"), F.lit("write"), F.lit("parked")), (c("event_id") % 3 + 1).cast("int"))
    return E.worker_shares(t.events.select("user_id", state.alias("state"), (c("event_id") + 1).alias("time_ns")), ["user_id"])


@query("w06_counter_deltas", "select event_id, case when v is not null and b is not null then greatest(v - b, 0) end as delta from (select *, lag(v) over (partition by user_id order by ts, event_id) as b from (select *, case when event_id % 13 <> 0 then event_id * 7919 % 1000 end as v from events))")
def w06(t):
    obs = t.events.withColumn("v", F.when(c("event_id") % 13 != 0, c("event_id") * 7919 % 1000)).withColumn("at", F.struct("ts", "event_id"))
    return E.counter_deltas(obs, "user_id", "at", "v").select("event_id", "delta")


def _samples(t):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(c("user_id").alias("run"), (n * 2).cast("int").alias("t"), F.when(c("event_id") % 29 == 0, 0).otherwise(n * 100 + c("event_id") % 2 * 50).cast("long").alias("bytes"))


_RATE = """
with s as (select user_id as run, n * 2 as t, case when event_id % 29 = 0 then 0 else n * 100 + event_id % 2 * 50 end as bytes from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events)),
k as (select *, lag(bytes) over (partition by run order by t) as b from s),
p as (select *, sum(case when bytes < b then 1 else 0 end) over (partition by run order by t) as part from k where b is null or b <> bytes),
r as (select run, part, t, bytes, (select max(q.t) from p q where q.run = p.run and q.part = p.part and q.t <= p.t - 5) as bt, min(t) over (partition by run, part) as ft from p),
f as (select run, part, t, bytes, coalesce(bt, ft) as base from r)
"""


@query("w07_rolling_rate", _RATE + "select f.run, f.t, f.bytes, case when f.t = f.base then 0 else (f.bytes - p.bytes) / (f.t - f.base) end as rate from f join p on p.run = f.run and p.part = f.part and p.t = f.base")
def w07(t):
    return E.rolling_rate(_samples(t))


@query("w08_eta", _RATE + "select f.run, f.t, case when f.t > 6 and f.t > f.base and f.bytes > p.bytes then round((100000 - f.bytes) / ((f.bytes - p.bytes) / (f.t - f.base)), 6) end as eta_s from f join p on p.run = f.run and p.part = f.part and p.t = f.base")
def w08(t):
    rates = E.rolling_rate(_samples(t)).withColumns({"remaining": 100000 - c("bytes"), "scan_done": c("t") > 6})
    return E.eta(rates).select("run", "t", F.round("eta_s", 6).alias("eta_s"))


@query("w09_span_union", """
with o as (select *, max(end_ms) over (partition by run, phase order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from spans),
i as (select *, sum(case when start_ms > reach then 1 else 0 end) over (partition by run, phase order by start_ms, end_ms rows unbounded preceding) as island from o)
select run, phase, sum(len)::bigint as covered_ms, count(*) as islands from (select run, phase, island, max(end_ms) - min(start_ms) as len from i group by all) group by run, phase""")  # fmt: skip
def w09(t):
    return E.span_union(t.spans, ["run", "phase"])


@query("w09_without_excluded", """
with x as (select *, start_ms + 500 as a, start_ms + 900 as b from spans where phase = 'scan'),
e as (select run, phase, start_ms, a as end_ms from x where a < end_ms union all select run, phase, b, end_ms from x where a < end_ms and b < end_ms union all select run, phase, start_ms, end_ms from x where a >= end_ms union all select run, phase, start_ms, end_ms from spans where phase <> 'scan'),
o as (select *, max(end_ms) over (partition by run, phase order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from e),
i as (select *, sum(case when start_ms > reach then 1 else 0 end) over (partition by run, phase order by start_ms, end_ms rows unbounded preceding) as island from o)
select run, phase, sum(len)::bigint as covered_ms, count(*) as islands from (select run, phase, island, max(end_ms) - min(start_ms) as len from i group by all) group by run, phase""")  # fmt: skip
def w09_excluded(t):
    scan = c("phase") == "scan"
    spans = t.spans.withColumns({"excluded_start": F.when(scan, c("start_ms") + 500), "excluded_end": F.when(scan, c("start_ms") + 900)})
    return E.span_union(E.without_excluded(spans), ["run", "phase"])


_VISITS = "select *, sum(new) over (partition by run order by sequence rows unbounded preceding)::bigint as visit from (select *, case when lag(workers) over (partition by run order by sequence) = workers and lag(segment) over (partition by run order by sequence) = segment then 0 else 1 end as new from measurements)"


@query("w10_measurement_visits", f"select run, sequence, workers, visit from ({_VISITS})")
def w10(t):
    return E.visits(t.measurements).select("run", "sequence", "workers", "visit")


# An order-dependent fold: tests compare it with a plain loop.
@query("w11_visit_score")
def w11(t):
    return E.visit_scores(t.measurements)


_SCORES = "select run, workers, visit, avg(rate) as rate from ({0}) where usable group by run, workers, visit".format(_VISITS)


def _scores(t):
    return E.visits(t.measurements).filter("usable").groupBy("run", "workers", "visit").agg(F.avg("rate").alias("rate"))


_PREFERENCE = f"""
s as ({_SCORES}), l as (select run, workers, arg_max(rate, visit) as rate from s group by run, workers),
o as (select *, max(rate) over w as best, min(workers) over w as least, max(workers) over w as most, count(*) over w as n from l window w as (partition by run)),
u as (select *, rate / best - 0.001 * log2(workers / least) as utility from o where n >= 2 and best > 0),
x as (select run, arg_max(workers, struct_pack(u := utility, w := workers)) as workers, any_value(most) as most from u group by run),
pref as (select x.run, x.workers, exists (select 1 from u where u.run = x.run and u.workers <> x.workers and u.rate >= 0.95 * u.best) as refine, x.workers = x.most as lower_bound from x)"""


@query("w12_run_preference", f"with {_PREFERENCE} select * from pref")
def w12(t):
    return E.run_preference(_scores(t))


@query("w13_starting_count", f"""with {_PREFERENCE},
k as (select run % 5 as route, run, 100 - run % 40 as day, workers, lower_bound, row_number() over (partition by run % 5 order by run desc) as rank from pref),
w as (select *, 2.0 ^ (-greatest(100 - day, 0) / 7.0) / rank as w from k where rank <= 32),
m as (select route, min(workers) as least, sum(w) as total from w group by route),
c as (select distinct route, workers as cand from w),
d as (select c.route, cand, round(sum(w * case when lower_bound then greatest(-log2(cand / workers), 0) else abs(log2(cand / workers)) end) + any_value(total) * 0.01 * log2(cand / any_value(least)), 9) as loss from c join w using (route) join m using (route) group by c.route, cand)
select route, arg_min(cand, struct_pack(l := loss, n := -cand)) as workers from d group by route""")  # fmt: skip
def w13(t):
    prefs = E.run_preference(_scores(t)).select((c("run") % 5).alias("route"), "run", (100 - c("run") % 40).alias("day"), "workers", "lower_bound")
    return E.starting_count(prefs, ["route"], 100)


_HINT = """
k{n} as (select {keys}, run, day, workers, lower_bound, row_number() over (partition by {keys} order by run desc) as rank from rp where {known}),
w{n} as (select *, 2.0 ^ (-greatest(100 - day, 0) / 7.0) / rank as w from k{n} where rank <= 32),
m{n} as (select {keys}, min(workers) as least, sum(w) as total from w{n} group by {keys}),
c{n} as (select distinct {keys}, workers as cand from w{n}),
d{n} as (select {keys}, cand, round(sum(w * case when lower_bound then greatest(-log2(cand / workers), 0) else abs(log2(cand / workers)) end) + any_value(total) * 0.01 * log2(cand / any_value(least)), 9) as loss from c{n} join w{n} using ({keys}) join m{n} using ({keys}) group by {keys}, cand),
h{n} as (select {keys}, arg_min(cand, struct_pack(l := loss, n := -cand)) as workers from d{n} group by {keys})"""


@query("w13_filesystem_then_route", f"""with {_PREFERENCE},
rp as (select run % 5 as route, case when run % 7 < 3 then 'fs' || run % 3 end as fs, run, 100 - run % 40 as day, workers, lower_bound from pref),
{_HINT.format(n=1, keys='route, fs', known='fs is not null')}, {_HINT.format(n=2, keys='route', known='true')},
asked as (select distinct run % 6 as route, 'fs' || run % 4 as fs from results)
select asked.route, asked.fs, coalesce(h1.workers, h2.workers) as workers, case when h1.workers is not null then 'filesystem' when h2.workers is not null then 'route' end as matched
from asked left join h1 on h1.route = asked.route and h1.fs = asked.fs left join h2 on h2.route = asked.route""")
def w13_hint(t):
    fs = F.when(c("run") % 7 < 3, F.concat(F.lit("fs"), (c("run") % 3).cast("string")))
    prefs = E.run_preference(_scores(t)).select((c("run") % 5).alias("route"), fs.alias("fs"), "run", (100 - c("run") % 40).alias("day"), "workers", "lower_bound")
    contexts = t.results.select((c("run") % 6).alias("route"), F.concat(F.lit("fs"), (c("run") % 4).cast("string")).alias("fs")).distinct()
    return E.starting_hint(contexts, prefs, ["route"], ["fs"], 100)


# The hint names the run that decided; only runs on the same file systems ask for refinement.
@query("w13_refine_and_run", f"""with {_PREFERENCE},
rp as (select run % 5 as route, case when run % 7 < 3 then 'fs' || run % 3 end as fs, run, 100 - run % 40 as day, workers, lower_bound from pref),
{_HINT.format(n=1, keys='route, fs', known='fs is not null')}, {_HINT.format(n=2, keys='route', known='true')},
b1 as (select h.route, h.fs, h.workers, max(w.run) as run from h1 h join w1 w on w.route = h.route and w.fs = h.fs and w.workers = h.workers group by all),
b2 as (select h.route, h.workers, max(w.run) as run from h2 h join w2 w on w.route = h.route and w.workers = h.workers group by all),
asked as (select distinct run % 6 as route, 'fs' || run % 4 as fs from results)
select asked.route, asked.fs, coalesce(b1.workers, b2.workers) as workers, case when b1.workers is not null then 'filesystem' when b2.workers is not null then 'route' end as matched, coalesce(b1.run, b2.run) as run,
  case when b1.workers is not null then coalesce(p.refine, false) when b2.workers is not null then false end as refine
from asked left join b1 on b1.route = asked.route and b1.fs = asked.fs left join b2 on b2.route = asked.route left join pref p on p.run = b1.run""")
def w13_refine(t):
    fs = F.when(c("run") % 7 < 3, F.concat(F.lit("fs"), (c("run") % 3).cast("string")))
    prefs = E.run_preference(_scores(t)).select((c("run") % 5).alias("route"), fs.alias("fs"), "run", (100 - c("run") % 40).alias("day"), "workers", "lower_bound", "refine")
    contexts = t.results.select((c("run") % 6).alias("route"), F.concat(F.lit("fs"), (c("run") % 4).cast("string")).alias("fs")).distinct()
    return E.starting_hint(contexts, prefs, ["route"], ["fs"], 100)


_RUNS = "select run, sum(bytes) as bytes, bool_or(type = 'result') as finished, 100 - run % 6 as updated_day from results group by run"


@query("w14_retention", f"""
with r as (select *, run = 7 or not finished and updated_day >= 98 as stays from ({_RUNS}))
select run, stays or sum(case when stays then 0 else bytes end) over (order by run desc rows unbounded preceding) + (select coalesce(sum(bytes), 0) from r where stays) <= 20000000 as keep from r""")
def w14(t):
    runs = t.results.groupBy("run").agg(F.sum("bytes").alias("bytes"), F.max(c("type") == "result").alias("finished")).withColumn("updated_day", 100 - c("run") % 6)
    return E.retention(runs, 20000000, current=7, today=100).select("run", "keep")


@query("g16_history_list", """
select run, (date '1970-01-01' + (20000 + run)::int)::date as date, status, elapsed / 1000 as seconds, files, bytes, n as events
from (select run, count(*) as n, max(status) as status, count(*) filter (disposition = 'transferred') as files, sum(bytes)::bigint as bytes, run * 37 as elapsed from results group by run) order by run desc limit 50""")
def g16(t):
    runs = t.results.groupBy("run").agg(F.max("status").alias("status"), F.count_if(c("disposition") == "transferred").alias("files"), F.sum("bytes").alias("bytes"))
    return E.history_list(runs.withColumns({"day": 20000 + c("run"), "elapsed_ms": c("run") * 37}), t.results.select("run"), 50)


@query("o05_newest_runs", "select run from (select distinct run from results) order by run desc limit 10")
def o05(t):
    return t.results.select("run").distinct().orderBy(F.desc("run")).limit(10)


_VARIED = "select run, count(distinct workers) filter (usable and rate >= 0) >= 2 and coalesce(max(rate) filter (usable and rate >= 0) > 0, false) as eligible from measurements group by run"


@query("g17_run_eligibility", _VARIED)
def g17(t):
    return E.run_eligibility(t.measurements)


@query("g17_eligible_contexts", f"select run, eligible and not (run % 5 = 0 or run % 7 = 0) and run % 3 <> 0 as eligible from ({_VARIED})")
def g17_contexts(t):
    starts = t.results.filter("seq = 0").select("run", (c("run") % 5 != 0).alias("automatic"), F.when(c("run") % 7 == 0, "workers").alias("overrides"))
    contexts = t.results.filter("seq < 2").select("run", "seq", ((c("run") % 3 != 0) | (c("seq") == 0)).alias("consistent"), F.lit(True).alias("automatic"))
    return E.run_eligibility(t.measurements, starts, contexts)


@query("g18_trial_medians", """select "case", variant, median(seconds) as median_s, count(*) as n from trials where verified group by "case", variant""")
def g18(t):
    return E.trial_medians(t.trials, ["case", "variant"])


_PAIRED = """select r."case", r.variant, median(r.seconds / b.seconds) as median_ratio, max(r.seconds / b.seconds) as worst_ratio, count(*) as pairs
from trials r join trials b on r."case" = b."case" and r.round = b.round and b.variant = 'F' where r.variant <> 'F' and r.verified and b.verified and r.seconds > 0 and b.seconds > 0 group by r."case", r.variant"""


@query("g19_paired_ratios", _PAIRED)
def g19(t):
    return E.paired_ratios(t.trials, "F")


@query("o06_worst_slowdown_first", f"""select row_number() over (order by worst_ratio desc, "case", variant) as nth, "case", variant, worst_ratio from ({_PAIRED})""")
def o06(t):
    ranked = Window.orderBy(F.desc("worst_ratio"), "case", "variant")
    return E.paired_ratios(t.trials, "F").select(F.row_number().over(ranked).cast("long").alias("nth"), "case", "variant", "worst_ratio")


_CLASSIFIED = """
select *, case when asset = 'install.sh' then 'installer' when asset = 'tool-release-manifest.json' then 'manifest' when asset = 'tool.rb' then 'formula' when suffix(asset, '.sha256') then 'checksum' when suffix(asset, '.gz') then 'archive' when starts_with(asset, 'tool-') then 'binary' else 'other' end as kind,
  case when target_header is not null then target_header when starts_with(asset, 'tool-linux-x64') then 'linux-x64' when starts_with(asset, 'tool-macos-arm64') then 'macos-arm64' end as target,
  nullif(regexp_extract(user_agent, '^(tool|curl|Homebrew)/([0-9][0-9A-Za-z.\\-]*)', 1), '') as client, nullif(regexp_extract(user_agent, '^(tool|curl|Homebrew)/([0-9][0-9A-Za-z.\\-]*)', 2), '') as client_version,
  case when purpose_header in ('check', 'interactive') then purpose_header end as purpose from download_events"""


@query("s11_classify_download", f"select event_id, kind, target, client, client_version, purpose from ({_CLASSIFIED})")
def s11(t):
    return E.classify_download(t.download_events).select("event_id", "kind", "target", "client", "client_version", "purpose")


@query("g14_daily_checks", f"select day, client_version, target, country, count(*) as checks from ({_CLASSIFIED}) where kind = 'manifest' and latest = 1 and purpose = 'check' group by all")
def g14(t):
    return E.daily_checks(E.classify_download(t.download_events))


@query("g15_daily_installs", f"select day, kind, tag, target, country, count(*) as downloads from ({_CLASSIFIED}) where kind in ('archive', 'binary') group by all")
def g15(t):
    return E.daily_installs(E.classify_download(t.download_events))
