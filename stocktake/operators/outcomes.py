"""Accounting for outcomes: totals, summaries, statuses, checks of a record stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordering

# The exit code of each terminal status.
EXIT_CODES = {"success": 0, "failed": 1, "aborted": 1, "partial": 23, "refused": 25}


def run_totals(results: DataFrame) -> DataFrame:
    n = lambda d: F.count_if(F.col("disposition") == d)
    size = lambda d: F.coalesce(F.sum(F.when(F.col("disposition") == d, F.col("bytes"))), F.lit(0))
    return results.groupBy("run").agg(n("transferred").alias("transferred"), n("unchanged").alias("unchanged"), n("excluded").alias("excluded"), n("failed").alias("failed"), size("transferred").alias("bytes_transferred"), size("unchanged").alias("bytes_unchanged"))


def result_totals(records: DataFrame) -> DataFrame:
    """The counters of each run's terminal record, from records(run, type, kind, disposition, bytes, diagnostic_for).

    Files by disposition; directories, links and specials only where they were made; errors that explain no other record; bytes of files.
    """
    is_ = lambda kind, d: (F.col("kind") == kind) & (F.col("disposition") == d)
    count = lambda kind, d, name: F.count_if(is_(kind, d)).alias(name)
    size = lambda d: F.coalesce(F.sum(F.when(is_("file", d), F.col("bytes"))), F.lit(0)).alias(f"bytes_{d}")
    return records.groupBy("run").agg(
        count("file", "transferred", "files_transferred"), count("file", "unchanged", "files_unchanged"), count("file", "excluded", "files_excluded"), count("dir", "transferred", "directories_created"),
        count("symlink", "transferred", "symlinks_created"), count("special", "transferred", "specials_created"), F.count_if((F.col("type") == "error") & F.col("diagnostic_for").isNull()).alias("errors"), size("transferred"), size("unchanged"),
    )


def dry_run_changes(plan: DataFrame) -> DataFrame:
    """One row: what a plan(kind, action, reason) would change. Files, directories, links, specials and entries of which only attributes
    change are apart; type replacements count among them once more."""
    acts, n = lambda *x: F.col("action").isin(*x), F.count_if
    return plan.agg(
        n(acts("transfer_file")).alias("regular_files"), n(acts("create")).alias("directories"), n(acts("create_link")).alias("symlinks"), n(acts("create_special")).alias("specials"), n(acts("set_attributes")).alias("metadata_only"),
        n(acts("transfer_file", "create", "create_link", "create_special") & (F.col("reason") == "type_differs")).alias("type_replacements"),
    )


def summary_rate(results: DataFrame) -> DataFrame:
    """Bytes a second of each run of results(run, ts, bytes); a run is held to last a millisecond at least."""
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return results.groupBy("run").agg((F.sum("bytes") / F.greatest(seconds, F.lit(0.001))).alias("rate"))


def dry_run_summary(plan: DataFrame) -> DataFrame:
    """Disjoint categories of a plan(action, reason, bytes)."""
    category = F.when(F.col("action") == "none", "nothing").when(F.col("reason") == "type_differs", "replaced").when(F.col("action") == "set_attributes", "attributes").when(F.col("reason") == "destination_missing", "new").otherwise("changed")
    return plan.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def removal_totals(selected: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: selectors by status of selected(selector, status), entries by disposition of removed(path, disposition)."""
    s = selected.agg(F.count("*").alias("selectors"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") == "missing").alias("missing"))
    r = removed.agg(F.count("*").alias("planned"), F.count_if(F.col("disposition") == "removed").alias("removed"), F.count_if(F.col("disposition") == "already_absent").alias("absent"), F.count_if(F.col("disposition") == "failed").alias("failed"))
    return s.crossJoin(F.broadcast(r))


def errors_counted(results: DataFrame) -> DataFrame:
    """Errors that explain no other record."""
    return results.groupBy("run").agg(F.count_if((F.col("type") == "error") & F.col("diagnostic_for").isNull()).alias("errors"))


def run_status(results: DataFrame) -> DataFrame:
    """Status and exit code of each run: what its terminal record says, else unknown; a failed entry makes a success partial.

    A run that failed or was aborted, or of which there is no terminal record, exits with 1, one that a safety cap refused with 25.
    """
    of = results.groupBy("run").agg(F.max("status").alias("said"), F.count_if(F.col("disposition") == "failed").alias("failed"))
    status = F.when(F.col("said").isNull(), "unknown").when((F.col("said") == "success") & (F.col("failed") > 0), "partial").otherwise(F.col("said"))
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in EXIT_CODES.items() for x in kv)), F.col("status")), F.lit(1))
    return of.withColumn("status", status).select("run", "status", code.alias("exit_code"))


def sequence_check(results: DataFrame) -> DataFrame:
    """Whether a run's records are numbered from 0 without gaps or repeats and end with its only terminal record. A run of any length is combined before it is shuffled."""
    end = F.col("type") == "result"
    each = results.groupBy("run", "seq").agg(F.count("*").alias("n"), F.count_if(end).alias("ends"))
    of = each.groupBy("run").agg(
        F.count("*").alias("numbers"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.max("n").alias("most"), F.count_if(F.col("seq").isNull()).alias("without"), F.sum("ends").alias("terminals"), F.max(F.when(F.col("ends") > 0, F.col("seq"))).alias("terminal"),
    )
    gap = (F.col("without") > 0) | (F.col("first") != 0) | (F.col("numbers") != F.col("last") + 1) | (F.col("most") > 1)
    verdict = F.when(gap, "gap").when(F.col("terminals") == 0, "no_terminal").when(F.col("terminals") > 1, "two_terminals").when(F.col("terminal") != F.col("last"), "not_last").otherwise("ok")
    return of.select("run", verdict.alias("verdict"))


def numbered(records: DataFrame) -> DataFrame:
    """seq of records(run, phase, path): rising from 0 in each run, the run record first, the result last. A long run is many ranges."""
    return ordering.numbered(records, ["phase", "path"], "seq", ["run"]).withColumn("seq", F.col("seq") - 1)
