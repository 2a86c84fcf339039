"""Listings that arrive again and again, each met by what the one before it led to: the destination's entries are state, by buckets of paths."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_HELD = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mtime_s", pa.int64()), ("mtime_ns", pa.int32()), ("met", pa.int64())])
_PLAN = "path string, snapshot long, action string, reason string, bytes long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _same_time(source: tuple, held: tuple) -> bool:
    """Equal seconds, and fractions equal at the precision that the destination shows; a zero fraction matches all (functions.values.mtime_matches)."""
    if None in (*source[2:], *held[2:]) or source[2] != held[2]:
        return False
    step = 1
    while held[3] and held[3] % (step * 10) == 0:
        step *= 10
    return not held[3] or source[3] // step == held[3] // step


def decide(source: tuple | None, held: tuple | None) -> tuple[str, str]:
    """action and reason for a source entry (kind, size, mtime_s, mtime_ns) and what the destination holds at its path; None is no entry."""
    if source is None:
        return ("none", "absent") if held is None else ("remove", "source_gone")
    if held is None:
        return "transfer", "destination_missing"
    if source[0] != held[0]:
        return "transfer", "type_differs"
    if source[0] == "dir":
        return "none", "unchanged"
    return ("none", "unchanged") if source[1] == held[1] and _same_time(source, held) else ("transfer", "content_differs")


def _plain(x):
    return None if pd.isna(x) else x if isinstance(x, str) else int(x)


class _Reconciler(StatefulProcessor):
    """The state of a bucket is one value, the entries of its paths in Arrow's format: a bucket's rows cost one read and one write of it."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "entries binary", self.ttl_ms)

    def _entries(self, now: int) -> dict[str, tuple]:
        """What is held by path, and when a listing met it last; entries that have expired are left out."""
        if not self.held.exists():
            return {}
        with pa.ipc.open_stream(bytes(self.held.get()[0])) as stream:
            columns = [x.to_pylist() for x in stream.read_all().itercolumns()]
        held = {path: (tuple(entry), met) for path, *entry, met in zip(*columns)}
        return held if self.ttl_ms is None else {k: v for k, v in held.items() if v[1] + self.ttl_ms > now}

    def _keep(self, held: dict[str, tuple]) -> None:
        if not held:
            self.held.clear()
            return
        rows = [(path, *entry, met) for path, (entry, met) in held.items()]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD) as stream:
            stream.write_table(pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), _HELD)], schema=_HELD))
        self.held.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        now = 0 if self.ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
        held, out = self._entries(now), []
        listed = [(r.path, int(r.snapshot), tuple(map(_plain, (r.kind, r.size, r.mtime_s, r.mtime_ns)))) for f in rows for r in f.itertuples(index=False)]
        for path, snapshot, entry in sorted(listed, key=lambda r: (r[1], *map(str, r[2][:3]))):
            source = None if entry[0] is None else entry
            before = held[path][0] if path in held else None
            action, reason = decide(source, before)
            out.append((path, snapshot, action, reason, source[1] if source and action == "transfer" else None))
            after = source if action != "none" else before
            if after is None:
                held.pop(path, None)
            else:
                held[path] = after, now  # also where nothing changed: what is still listed does not expire
        self._keep(held)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _PLAN.split(", ")]).astype({"bytes": "Int64"})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        now = 0 if self.ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
        held = self._entries(now)  # a bucket may come in several pieces
        held |= {r.path: (tuple(map(_plain, (r.kind, r.size, r.mtime_s, r.mtime_ns))), now) for r in initialState.itertuples(index=False)}
        self._keep(held)

    def close(self) -> None:
        pass


def incremental_reconcile(listings: DataFrame, destination: DataFrame | None = None, ttl_ms: int | None = None, buckets: int = 1024) -> DataFrame:
    """path, snapshot, action (transfer, remove, none), reason and bytes for each row of the stream listings(path, snapshot, kind, size, mtime_s, mtime_ns).

    The first listing of a path meets destination(path, kind, size, mtime_s, mtime_ns), which has one
    row for each path; each later one meets the result of the one before, which is kept as state by path. Paths are dealt to hash buckets, and a bucket's entries are read and written
together, so that a row costs no call of the state store; a checkpoint goes on with the `buckets` that it began with. So a
    repeated listing plans nothing, and no batch reads the destination again. A null kind says that the path is gone from the
    source. Rows of one path in one batch go in the order of `snapshot`. State that no listing
    has met for ttl_ms is dropped, after which the path counts as missing. Sessions have to keep state in RocksDB (rocksdb_state); restarted
    from its checkpoint the stream goes on with the state it had.
    """
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
    shape = lambda df, *more: df.select(bucket, "path", *more, "kind", F.col("size").cast("long").alias("size"), F.col("mtime_s").cast("long").alias("mtime_s"), F.col("mtime_ns").cast("int").alias("mtime_ns"))
    rows = shape(listings, F.col("snapshot").cast("long").alias("snapshot")).groupBy("bucket")
    first = None if destination is None else shape(destination).groupBy("bucket")
    return rows.transformWithStateInPandas(_Reconciler(ttl_ms), _PLAN, "Append", "None" if ttl_ms is None else "ProcessingTime", first)


def planned(listings: DataFrame, out: str, log: str, destination: DataFrame | None = None, ttl_ms: int | None = None, buckets: int = 1024) -> None:
    """Runs incremental_reconcile over what is there; plans are written below out, one folder for each batch, and log is the checkpoint to go on from."""
    plan = incremental_reconcile(listings, destination, ttl_ms, buckets)
    # a batch that runs again replaces its own folder
    writer = plan.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    with rocksdb_state(plan.sparkSession):
        query = writer.start()
    query.awaitTermination()


def plans(spark: SparkSession, out: str) -> DataFrame:
    """What planned() has written."""
    return spark.read.option("recursiveFileLookup", True).schema(_PLAN).parquet(out)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep their state in RocksDB and run no batches without rows, of which state that expires asks for one after another; the session's settings come back after that."""
    wanted = {_PROVIDER: _ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
