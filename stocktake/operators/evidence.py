"""Analysis of recorded performance evidence and of download logs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_total


def counter_deltas(obs: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Difference to the previous sample, at least 0; null where either is null."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return obs.withColumn("delta", F.when(F.col(value).isNotNull() & before.isNotNull(), F.greatest(F.col(value) - before, F.lit(0))))


def rolling_rate(samples: DataFrame, window: float = 5.0, least: float = 0.2) -> DataFrame:
    """Rate of samples(run, t, bytes) over the last seconds.

    Samples without a change of bytes are left out; the sample before the window is its base; a fall of bytes starts anew; times too close give 0.
    """
    by_run = Window.partitionBy("run").orderBy("t")
    changed = samples.withColumn("__before", F.lag("bytes").over(by_run)).filter(F.col("__before").isNull() | (F.col("__before") != F.col("bytes")))
    part = F.sum(F.coalesce((F.col("bytes") < F.col("__before")).cast("int"), F.lit(0))).over(by_run)
    parted = changed.withColumn("part", part)
    own = Window.partitionBy("run", "part").orderBy("t")
    earlier = own.rangeBetween(Window.unboundedPreceding, -int(window))
    base = lambda c: F.coalesce(F.max_by(c, "t").over(earlier), F.first(c).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    based = parted.withColumn("__t", base("t")).withColumn("__b", base("bytes"))
    seconds = F.col("t") - F.col("__t")
    return based.select("run", "t", "bytes", F.when(seconds < least, 0.0).otherwise((F.col("bytes") - F.col("__b")) / F.nullif(seconds, F.lit(0))).alias("rate"))


def span_union(spans: DataFrame, keys: Sequence[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """Covered length of overlapping spans(start_ms, end_ms), clipped to low..high."""
    start = F.greatest(F.col("start_ms"), F.lit(low)) if low is not None else F.col("start_ms")
    end = F.least(F.col("end_ms"), F.lit(high)) if high is not None else F.col("end_ms")
    clipped = spans.select(*keys, start.alias("start_ms"), end.alias("end_ms")).filter("start_ms < end_ms")
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = clipped.withColumn("__reach", reach).withColumn("__new", F.coalesce((F.col("start_ms") > F.col("__reach")).cast("int"), F.lit(0)))
    parted = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parted.groupBy(*keys, "__island").agg((F.max("end_ms") - F.min("start_ms")).alias("length"))
    return merged.groupBy(*keys).agg(F.sum("length").alias("covered_ms"), F.count("*").alias("islands"))


def visits(measurements: DataFrame) -> DataFrame:
    """visit: consecutive measurements of one (segment, workers); a return is a new visit."""
    order = Window.partitionBy("run").orderBy("sequence")
    same = (F.lag("segment").over(order) == F.col("segment")) & (F.lag("workers").over(order) == F.col("workers"))
    marked = measurements.withColumn("__new", (~F.coalesce(same, F.lit(False))).cast("int"))
    return marked.withColumn("visit", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _conclusion(recent: list[tuple[float, float]], base: float) -> float | None:
    """The mean rate of the newest intervals that show a clear difference to the rate of the setting before, if any do.

    The clearer the difference, the fewer seconds it takes: a loss of half after 1, of a
    fifth or a gain of a fifth after 2.5, a twentieth after 5; two intervals at least. Silence alone is no early loss.
    """
    if base <= 0 or not np.isfinite(base):
        return None
    rate, seconds = np.array(recent[::-1]).T
    elapsed, low, high = np.cumsum(seconds), np.minimum.accumulate(rate), np.maximum.accumulate(rate)
    clear = (elapsed >= 1) & (low > 0) & (high < 0.5 * base)
    clear |= (elapsed >= 2.5) & ((low > 0) & (high < base * 0.8) | (low > base * 1.2))
    clear |= (elapsed >= 5) & ((high < base * 0.95) | (low * 0.95 > base))
    found = np.flatnonzero(clear[1:])
    if not len(found):
        return None
    n = int(found[0]) + 2
    return float((rate[:n] * seconds[:n]).sum() / elapsed[n - 1])


def visit_scores(measurements: DataFrame, least_s: float = 2.5, most_s: float = 5.0) -> DataFrame:
    """run, visit, workers and rate: the last score of each visit.

    A score is the mean of the newest intervals that differ clearly from the last score
    of the visit before (_conclusion), else the time-weighted mean of the recent
    intervals. Intervals that are not usable, not finite or negative start the recent window anew. It
    holds two intervals at least and drops old ones once the rest lasts most_s. Rows depend on those before, so each
    run is one group; a run has few.
    """

    def score(f: pd.DataFrame) -> pd.DataFrame:
        rows, base, last, visit = [], 0.0, None, None
        recent: list[tuple[float, float]] = []
        for v, workers, value, seconds, usable in f.sort_values("sequence")[["visit", "workers", "rate", "seconds", "usable"]].itertuples(index=False):
            if v != visit:
                base, last, visit, recent = last or 0.0, None, v, []
                rows.append([f["run"].iloc[0], v, workers, None])
            if not (usable and np.isfinite(value) and value >= 0 and np.isfinite(seconds) and seconds > 0):
                recent = []
                continue
            recent.append((value, seconds))
            while len(recent) > 2 and sum(s for _, s in recent[1:]) >= most_s:
                recent.pop(0)
            total = sum(s for _, s in recent)
            mean = sum(x * s for x, s in recent) / total if len(recent) >= 2 and total >= least_s else None
            found = _conclusion(recent, base)
            if found is not None or mean is not None:
                last = rows[-1][3] = mean if found is None else found
        return pd.DataFrame(rows, columns=["run", "visit", "workers", "rate"])

    of = visits(measurements).select("run", "visit", "workers", "sequence", "rate", "seconds", "usable")
    return of.groupBy("run").applyInPandas(score, "run long, visit long, workers long, rate double").filter("rate is not null")


def run_preference(scores: DataFrame) -> DataFrame:
    """The best number of workers of each run with two numbers or more: rate over best, less 0.001 for each doubling; refine if another comes within 5 %."""
    last = scores.groupBy("run", "workers").agg(F.max_by("rate", "visit").alias("rate"))
    by_run = Window.partitionBy("run")
    of = last.withColumns({"best": F.max("rate").over(by_run), "least": F.min("workers").over(by_run), "most": F.max("workers").over(by_run), "n": F.count("*").over(by_run)}).filter("n >= 2 and best > 0")
    of = of.withColumn("utility", F.col("rate") / F.col("best") - 0.001 * F.log2(F.col("workers") / F.col("least")))
    chosen = of.groupBy("run").agg(F.max_by("workers", F.struct("utility", "workers")).alias("chosen"), F.first("most").alias("most"), F.collect_set(F.when(F.col("rate") >= F.col("best") * 0.95, F.col("workers"))).alias("near"))
    return chosen.select("run", F.col("chosen").alias("workers"), (F.size(F.array_remove("near", F.col("chosen"))) > 0).alias("refine"), (F.col("chosen") == F.col("most")).alias("lower_bound"))


def starting_count(preferences: DataFrame, keys: Sequence[str], today: int, keep: int = 32, cost: float = 0.01) -> DataFrame:
    """The number of workers to start with for each key, from preferences(keys, run, day, workers, lower_bound).

    The newest runs count, by 2 ** (-age / 7) / (rank + 1); the candidate with the least
    weighted distance in doublings wins (one-sided for a run whose best was the highest tried), with a small cost for each doubling; ties go to the higher.
    At most `keep` rows of a key meet each other. Where preferences have `refine`, the result has the run that decided, the newest one that
    preferred the number, and that run's refine.
    """
    more = ["refine"] if "refine" in preferences.columns else []
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("run")))
    recent = preferences.withColumn("__rank", rank).filter(F.col("__rank") <= keep)
    weight = F.pow(F.lit(2.0), -F.greatest(F.lit(today) - F.col("day"), F.lit(0)) / 7.0) / F.col("__rank")
    recent = recent.withColumn("__w", weight)
    by_key = Window.partitionBy(*keys)
    recent = recent.withColumns({"__least": F.min("workers").over(by_key), "__total": F.sum("__w").over(by_key)})
    own = recent.groupBy(*keys, F.col("workers").alias("candidate"), "__least", "__total").agg(F.struct(F.max("run").alias("run"), *(F.max_by(c, "run").alias(c) for c in more)).alias("__by"))
    other = recent.select(*keys, F.col("workers").alias("__n"), "lower_bound", "__w")
    apart = F.log2(F.col("candidate") / F.col("__n"))
    distance = F.when(F.col("lower_bound"), F.greatest(-apart, F.lit(0.0))).otherwise(F.abs(apart))
    loss = own.join(other, list(keys)).groupBy(*keys, "candidate", "__least", "__total", "__by").agg(F.sum(F.col("__w") * distance).alias("__loss"))
    loss = loss.withColumn("__loss", F.round(F.col("__loss") + F.col("__total") * cost * F.log2(F.col("candidate") / F.col("__least")), 9))
    best = loss.groupBy(*keys).agg(F.min_by(F.struct(F.col("candidate").alias("workers"), "__by"), F.struct("__loss", -F.col("candidate"))).alias("b"))
    return best.select(*keys, "b.workers", *(f"b.__by.{c}" for c in (["run", *more] if more else [])))


def starting_hint(contexts: DataFrame, preferences: DataFrame, route: Sequence[str], filesystems: Sequence[str], today: int) -> DataFrame:
    """workers and matched for contexts(route, filesystems): from runs on the same file systems where there are any, else from all runs of the route.

    File systems that are not known match nothing. Where preferences have `refine`: also run, the one that decided, and refine, which only runs on the same file systems ask for.
    """
    more = ["run", "refine"] if "refine" in preferences.columns else []
    known = preferences.filter(F.forall(F.array(*(F.col(f).isNotNull() for f in filesystems)), lambda x: x))
    named = lambda df, which: df.withColumnsRenamed({c: f"__{which}_{c}" for c in more}).withColumnRenamed("workers", f"__{which}")
    near = named(starting_count(known, [*route, *filesystems], today), "near")
    far = named(starting_count(preferences, route, today), "far")
    joined = contexts.join(near, [*route, *filesystems], "left").join(far, list(route), "left")
    matched = F.when(F.col("__near").isNotNull(), "filesystem").when(F.col("__far").isNotNull(), "route")
    if more:
        decided = F.when(F.col("__near").isNotNull(), F.col("__near_run")).otherwise(F.col("__far_run"))
        refine = F.when(matched.isNotNull(), F.coalesce((matched == "filesystem") & F.col("__near_refine"), F.lit(False)))
    return joined.select(*route, *filesystems, F.coalesce("__near", "__far").alias("workers"), matched.alias("matched"), *([decided.alias("run"), refine.alias("refine")] if more else []))


def retention(runs: DataFrame, budget: int, current: int | None = None, today: int | None = None) -> DataFrame:
    """keep of runs(run, bytes, finished, updated_day): the oldest go until the others fit the budget.

    The current run stays, and so do unfinished runs that were updated since two days
    before today, whatever the budget; older unfinished ones may go like finished ones. Without today all unfinished runs stay.
    """
    fresh = F.lit(True) if today is None else F.col("updated_day") >= today - 2
    stays = (~F.col("finished") & fresh) | (F.lit(False) if current is None else F.col("run") == current)
    marked = runs.withColumn("__stays", stays)
    held = marked.agg(F.coalesce(F.sum(F.when(F.col("__stays"), F.col("bytes"))), F.lit(0)).alias("__held"))
    summed = running_total(marked, [F.desc("run")], F.when(F.col("__stays"), 0).otherwise(F.col("bytes")), "__newer").crossJoin(F.broadcast(held))
    return summed.withColumn("keep", F.col("__stays") | (F.col("__newer") + F.col("__held") <= budget)).select(*runs.columns, "keep")


def eta(rates: DataFrame) -> DataFrame:
    """eta_s of rates(rate, remaining, scan_done): what remains over the rate; null while the scan goes on or nothing moves."""
    return rates.withColumn("eta_s", F.when(F.col("scan_done") & (F.col("rate") > 0), F.col("remaining") / F.col("rate")))


def without_excluded(spans: DataFrame) -> DataFrame:
    """spans(start_ms, end_ms) without what their own excluded span (excluded_start, excluded_end) covers: up to two parts each."""
    a, b, start, end = (F.col(c) for c in ("excluded_start", "excluded_end", "start_ms", "end_ms"))
    meets = F.coalesce((a < end) & (b > start), F.lit(False))
    part = lambda low, high: F.struct(low.alias("start_ms"), high.alias("end_ms"))
    parts = F.when(meets, F.array(part(start, F.greatest(a, start)), part(F.greatest(b, start), end))).otherwise(F.array(part(start, end)))
    rest = [c for c in spans.columns if c not in ("start_ms", "end_ms", "excluded_start", "excluded_end")]
    return spans.select(*rest, F.explode(parts).alias("__p")).select(*rest, "__p.*").filter("start_ms < end_ms")


def history_list(runs: DataFrame, events: DataFrame, limit: int = 50) -> DataFrame:
    """run, date, status, seconds, files, bytes and events of the newest runs(run, day, status, elapsed_ms, files, bytes); events: run."""
    newest = runs.orderBy(F.desc("run")).limit(limit)
    counts = events.join(newest.select("run"), "run", "left_semi").groupBy("run").agg(F.count("*").alias("events"))
    joined = newest.join(counts, "run", "left")
    return joined.select("run", F.date_from_unix_date(F.col("day").cast("int")).alias("date"), "status", (F.col("elapsed_ms") / 1000).alias("seconds"), "files", "bytes", F.coalesce("events", F.lit(0)).alias("events"))


def strict_sum(value: Column) -> Column:
    """The sum if every row has the value, else null."""
    return F.when(F.count(value) == F.count("*"), F.sum(value))


def tcp_totals(sockets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of sockets(bytes_sent, bytes_retransmitted, rtt_us, busy_us, limited_us): only where every socket has the field.

    limited_percent: how much of the busy time windows or buffers held the sender back. The mean is in whole microseconds.
    """
    sent, again = strict_sum(F.col("bytes_sent")), strict_sum(F.col("bytes_retransmitted"))
    busy, limited = strict_sum(F.col("busy_us")), strict_sum(F.col("limited_us"))
    whole = F.count("rtt_us") == F.count("*")
    return sockets.groupBy(*keys).agg(sent.alias("bytes_sent"), again.alias("bytes_retransmitted"), (100.0 * again / F.nullif(sent, F.lit(0))).alias("loss_percent"), F.when(whole, F.min("rtt_us")).alias("rtt_min_us"), F.when(whole, F.floor(F.sum("rtt_us") / F.count("*"))).alias("rtt_avg_us"), F.when(busy > 0, 100.0 * limited / busy).alias("limited_percent"))


def worker_shares(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each state of obs(state, time_ns); parked time is left out."""
    of = obs.filter("state != 'parked'").groupBy(*keys, "state").agg(F.sum("time_ns").alias("time_ns"))
    return of.withColumn("share", F.col("time_ns") / F.sum("time_ns").over(Window.partitionBy(*keys)))


def run_eligibility(measurements: DataFrame, starts: DataFrame | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """eligible of each run: it tried two numbers of workers or more in usable measurements, and one rate is above 0.

    starts(run, automatic, overrides): a run that was not automatic, or had overrides,
    does not count. contexts(run, seq, consistent, automatic): the last one has to be both. A run that lacks them where they are given has no context and does not count.
    """
    good = F.col("usable") & F.col("workers").between(1, 65536) & (F.col("seconds") > 0) & (F.col("rate") >= 0)
    rates = measurements.groupBy("run").agg(F.count_distinct(F.when(good, F.col("workers"))).alias("varied"), F.coalesce(F.max(F.when(good, F.col("rate"))) > 0, F.lit(False)).alias("positive"))
    eligible = (F.col("varied") >= 2) & F.col("positive")
    if starts is not None:
        odd = starts.groupBy("run").agg(F.max(~F.coalesce("automatic", F.lit(True)) | F.col("overrides").isNotNull()).alias("__odd"))
        rates, eligible = rates.join(odd, "run", "left"), eligible & ~F.coalesce("__odd", F.lit(False))
    if contexts is not None:
        last = contexts.groupBy("run").agg(F.max_by(F.col("consistent") & F.col("automatic"), "seq").alias("__good"))
        rates, eligible = rates.join(last, "run", "left"), eligible & F.coalesce("__good", F.lit(False))
    return rates.select("run", eligible.alias("eligible"))


def trial_medians(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    return trials.filter("verified").groupBy(*keys).agg(F.median("seconds").alias("median_s"), F.count("*").alias("n"))


def paired_ratios(trials: DataFrame, reference: str) -> DataFrame:
    """Each variant against the reference in the same round of a case, both verified and above 0: median and worst ratio."""
    good = trials.filter("verified and seconds > 0")
    base = good.filter(F.col("variant") == reference).select("case", "round", F.col("seconds").alias("__base"))
    ratio = good.filter(F.col("variant") != reference).join(base, ["case", "round"]).withColumn("ratio", F.col("seconds") / F.col("__base"))
    return ratio.groupBy("case", "variant").agg(F.median("ratio").alias("median_ratio"), F.max("ratio").alias("worst_ratio"), F.count("*").alias("pairs"))


# Targets and purposes that are told apart.
TARGETS = ("linux-x64", "linux-arm64", "macos-x64", "macos-arm64")


def classify_download(requests: DataFrame, product: str = "tool") -> DataFrame:
    """kind, target, client, client_version and purpose of requests(asset, user_agent, target_header, purpose_header)."""
    asset = F.col("asset")
    kind = (
        F.when(asset == "install.sh", "installer").when(asset == f"{product}-release-manifest.json", "manifest").when(asset == f"{product}.rb", "formula")
        .when(F.endswith(asset, F.lit(".sha256")), "checksum").when(F.endswith(asset, F.lit(".gz")), "archive").when(F.startswith(asset, F.lit(f"{product}-")), "binary").otherwise("other")
    )
    target = F.when(F.col("target_header").isin(*TARGETS), F.col("target_header"))
    for t in TARGETS:
        target = F.coalesce(target, F.when(F.startswith(asset, F.lit(f"{product}-{t}")), F.lit(t)))
    agent = rf"^({product}|curl|Homebrew)/([0-9][0-9A-Za-z.\-]*)"
    part = lambda i: F.nullif(F.regexp_extract("user_agent", agent, i), F.lit(""))
    purpose = F.when(F.col("purpose_header").isin("check", "interactive"), F.col("purpose_header"))
    return requests.withColumns({"kind": kind, "target": target, "client": part(1), "client_version": part(2), "purpose": purpose})


def daily_installs(events: DataFrame) -> DataFrame:
    return events.filter("kind in ('archive', 'binary')").groupBy("day", "kind", "tag", "target", "country").agg(F.count("*").alias("downloads"))


def daily_checks(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'manifest' and latest = 1 and purpose = 'check'").groupBy("day", "client_version", "target", "country").agg(F.count("*").alias("checks"))
