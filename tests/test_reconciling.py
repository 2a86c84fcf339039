"""Incremental reconciliation: each listing meets the result of the one before, also after a restart."""

from stocktake.streaming import reconciling

LISTING = "path string, snapshot long, kind string, size long, mtime_s long, mtime_ns int"
FIRST = [("same", 1, "file", 5, 10, 7), ("new", 1, "file", 6, 10, 0), ("changed", 1, "file", 8, 20, 0), ("dir", 1, "dir", None, 1, 1), ("kind", 1, "symlink", 3, 1, 1)]
SECOND = [("same", 2, "file", 5, 10, 7), ("new", 2, "file", 6, 10, 0), ("changed", 2, "file", 4, 9, 0), ("gone", 2, None, None, None, None), ("dir", 2, "dir", None, 99, 1), ("kind", 2, "symlink", 3, 1, 1)]
THIRD = [("changed", 3, "file", 8, 20, 0), ("new", 3, None, None, None, None), ("gone", 3, "file", 1, 1, 1), ("new", 4, "file", 6, 10, 5)]
HELD = [("same", "file", 5, 10, 7), ("changed", "file", 4, 9, 0), ("gone", "file", 1, 1, 1), ("kind", "file", 3, 1, 1)]


def drain(spark, folder, destination, ttl=None):
    stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(f"{folder}/listings/*")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    reconciling.planned(stream, f"{folder}/plan", f"{folder}/log", destination, ttl)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    return {(r.path, r.snapshot): (r.action, r.reason, r.bytes) for r in reconciling.plans(spark, f"{folder}/plan").collect()}


def test_listings_meet_what_the_last_led_to(spark, tmp_path):
    held = spark.createDataFrame(HELD, "path string, kind string, size long, mtime_s long, mtime_ns int")
    put = lambda rows, n: spark.createDataFrame(rows, LISTING).coalesce(1).write.parquet(f"{tmp_path}/listings/{n}")
    put(FIRST, 1)
    got = drain(spark, tmp_path, held)
    assert got == {("same", 1): ("none", "unchanged", None), ("new", 1): ("transfer", "destination_missing", 6), ("changed", 1): ("transfer", "content_differs", 8), ("dir", 1): ("transfer", "destination_missing", None), ("kind", 1): ("transfer", "type_differs", 3)}
    put(SECOND, 2)  # the stream starts again from its checkpoint
    got = drain(spark, tmp_path, held)
    second = {k[0]: v[:2] for k, v in got.items() if k[1] == 2}
    assert second == {"same": ("none", "unchanged"), "new": ("none", "unchanged"), "changed": ("transfer", "content_differs"), "gone": ("remove", "source_gone"), "dir": ("none", "unchanged"), "kind": ("none", "unchanged")}
    put(THIRD, 3)
    got = drain(spark, tmp_path, held)
    third = {k: v[:2] for k, v in got.items() if k[1] > 2}
    assert third == {("changed", 3): ("transfer", "content_differs"), ("new", 3): ("remove", "source_gone"), ("gone", 3): ("transfer", "destination_missing"), ("new", 4): ("transfer", "destination_missing")}
    assert drain(spark, tmp_path, held) == got  # nothing new, nothing planned


def test_decisions():
    d = reconciling.decide
    file = ("file", 1, 5, 0)
    assert d(None, None)[0] == "none" and d(file, None)[1] == "destination_missing" and d(file, ("dir", None, 5, 0))[1] == "type_differs"
    assert d(("file", 1, 5, 7), file)[0] == "none" and d(file, ("file", 1, 5, 7))[0] == "transfer" and d(("file", 1, 5, 1234), ("file", 1, 5, 1200))[0] == "none" and d(("file", 1, 5, 3), ("file", 1, 5, 7))[0] == "transfer" and d(("file", None, 5, 3), ("file", 1, 5, 3))[0] == "transfer"


def test_state_that_no_listing_meets_expires(spark, tmp_path):
    put = lambda rows, n: spark.createDataFrame(rows, LISTING).coalesce(1).write.parquet(f"{tmp_path}/listings/{n}")
    put([("a", 1, "file", 1, 1, 0)], 1)
    drain(spark, tmp_path, None, ttl=1)
    put([("a", 2, "file", 1, 1, 0)], 2)
    assert drain(spark, tmp_path, None, ttl=1)["a", 2][1] == "destination_missing"


def test_a_bucket_of_paths_is_one_read_and_one_write_of_state():
    import pandas as pd

    class State:
        value, calls = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.value = None

    of = reconciling._Reconciler(None)
    of.held = State()
    names = ["path", "snapshot", "kind", "size", "mtime_s", "mtime_ns"]
    held = pd.DataFrame([(f"p{i}", "file", i, 1, 0) for i in range(500)], columns=["path", *names[2:]])
    for piece in (held[:200], held[200:]):
        of.handleInitialState((0,), piece, None)
    of.held.calls = 0
    rows = pd.DataFrame([(f"p{i}", 1, "file" if i % 2 else None, i, 1, 0) for i in range(1000)], columns=names)
    out = pd.concat(of.handleInputRows((0,), iter([rows[:300], rows[300:]]), None)).set_index("path")
    assert of.held.calls == 2 and len(out) == 1000
    assert out.reason.map(lambda x: x).to_dict() == {f"p{i}": ("unchanged" if i < 500 else "destination_missing") if i % 2 else "source_gone" if i < 500 else "absent" for i in range(1000)}


def test_buckets_in_several_batches_of_rows(spark, tmp_path):
    held = [(f"p{i}", "file", i, 1, 0) for i in range(0, 60, 2)]
    rows = [(f"p{i}", 1, "file" if i % 5 else None, i + (i % 3 == 0), 1, 0) for i in range(60)] + [(f"p{i}", 2, "file", 7, 7, 7) for i in range(0, 60, 7)]
    spark.createDataFrame(rows, LISTING).repartition(3).write.parquet(f"{tmp_path}/rows")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        stream = spark.readStream.schema(LISTING).parquet(f"{tmp_path}/rows")
        reconciling.planned(stream, f"{tmp_path}/plan", f"{tmp_path}/log", spark.createDataFrame(held, "path string, kind string, size long, mtime_s long, mtime_ns int"), buckets=3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    state, want = {p: tuple(e) for p, *e in held}, {}
    for path, snapshot, *entry in rows:
        source = tuple(entry) if entry[0] else None
        want[path, snapshot] = reconciling.decide(source, state.get(path))
        if want[path, snapshot][0] != "none":
            state[path] = source
    assert {(r.path, r.snapshot): (r.action, r.reason) for r in reconciling.plans(spark, f"{tmp_path}/plan").collect()} == want
