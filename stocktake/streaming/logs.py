"""Structured Streaming over result streams, progress and download logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktake.operators.evidence import classify_download
from stocktake.sources.records import checked_results
from stocktake.sources.scratch import new_folder


def tail_results(spark: SparkSession, path: str) -> DataFrame:
    """Known records of result files as they arrive. Unknown types are ignored; a record of an unknown schema, version, status or path encoding ends the stream with an error."""
    return checked_results(spark.readStream.text(path))


def latest_progress(records: DataFrame) -> DataFrame:
    """The last record of each run so far (update or complete mode)."""
    return records.groupBy("run").agg(F.max("seq").alias("seq"), F.max_by("bytes", "seq").alias("bytes"))


def run_completion(records: DataFrame, silent_ms: int = 3_600_000) -> DataFrame:
    """run, records, errors, status and closed of each run so far: `unknown` until a terminal record comes (update mode).

    A run that is silent for silent_ms of processing time is closed as it stands, and its
    state is dropped: without a terminal record it ended as unknown.
    """

    def follow(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, errors, status = state.get if state.exists else (0, 0, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run": [key[0]], "records": [n], "errors": [errors], "status": [status or "unknown"], "closed": [True]})
            return
        for f in frames:
            n += len(f)
            errors += int((f["disposition"] == "failed").sum() + (f["type"] == "error").sum())
            ended = f.loc[f["type"] == "result", "status"]
            status = ended.iloc[-1] if len(ended) else status
        state.update((n, errors, status))
        state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame({"run": [key[0]], "records": [n], "errors": [errors], "status": [status or "unknown"], "closed": [False]})

    return records.groupBy("run").applyInPandasWithState(follow, "run long, records long, errors long, status string, closed boolean", "n long, errors long, status string", "update", "ProcessingTimeTimeout")


def live_installs(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Installs by day and kind; rows later than the watermark are dropped."""
    events = classify_download(requests).filter("kind in ('archive', 'binary')").withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 day"), "kind").agg(F.count("*").alias("downloads")).select(F.to_date("window.start").alias("day"), "kind", "downloads")


def live_checks(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Checks for updates by day; rows later than the watermark are dropped."""
    events = classify_download(requests).filter("kind = 'manifest' and latest = 1 and purpose = 'check'").withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("checks")).select(F.to_date("window.start").alias("day"), "checks")


def install_sessions(requests: DataFrame, gap: str = "5 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of requests of one address and target."""
    events = classify_download(requests).withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap), "ip", "target").agg(F.count("*").alias("requests")).select(F.unix_micros("session_window.start").alias("start_us"), "ip", "target", "requests")


def rate_windows(measurements: DataFrame, length: str = "10 seconds", slide: str = "2500 milliseconds", late: str = "1 minute") -> DataFrame:
    return measurements.withWatermark("ts", late).groupBy(F.window("ts", length, slide)).agg(F.avg("value").alias("rate"), F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), "rate", "n")


def once_each(records: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """One record for each key within the watermark."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, label: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over what is there and returns what it wrote; in complete mode the last state, in update mode every update with its batch."""
    spark = stream.sparkSession
    path, log = new_folder(spark, label), new_folder(spark, f"{label}-log")
    writer = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).outputMode(mode)

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "update":
            batch = batch.withColumn("batch", F.lit(number))
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}" if mode == "append" else path if mode == "complete" else f"{path}/{number}")

    # what is there is drained; a stream with timers would otherwise run empty batches for them without end
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")
    try:
        writer.foreachBatch(keep if each is None else each).start().awaitTermination()
    finally:
        spark.conf.set(empty, before)
    if each is not None:
        return None
    rows = spark.read.option("recursiveFileLookup", mode == "update").schema(stream.schema if mode != "update" else T.StructType([*stream.schema, T.StructField("batch", T.IntegerType())])).parquet(path)
    return rows.select(*stream.columns, *(["batch"] if mode == "update" else []))
