"""Every registered query of the library against its SQL on the given tables."""

import pytest
from conftest import same_rows

from stocktake.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    same_rows(registry.queries()[name](spark, sf), duck, SQL[name])


def test_every_query_gives_rows_or_none_without_sql(spark, sf):
    for name in sorted(set(registry.queries()) - set(SQL)):
        assert registry.queries()[name](spark, sf).count() > 0


def test_visit_scores_as_a_plain_loop(spark, sf):
    from stocktake.operators import evidence as E
    from stocktake.sources.derived import Tables

    def clear(recent, base):
        """The mean of the fewest newest intervals, two at least, that lie clearly below or above the setting before."""
        for n in range(2, len(recent) + 1):
            part = recent[-n:]
            seconds, low, high = sum(s for _, s in part), min(v for v, _ in part), max(v for v, _ in part)
            lost_half = seconds >= 1 and 0 < low and high < base / 2
            fifth = seconds >= 2.5 and (0 < low and high < 0.8 * base or low > 1.2 * base)
            twentieth = seconds >= 5 and (high < 0.95 * base or 0.95 * low > base)
            if lost_half or fifth or twentieth:
                return sum(v * s for v, s in part) / seconds
        return None

    rows = sorted(E.visits(Tables(spark, sf).measurements).collect(), key=lambda r: (r.run, r.visit, r.sequence))
    want, recent, direct = {}, {}, 0
    for r in rows:
        key = (r.run, r.visit, r.workers)
        if not r.usable or r.rate < 0:
            recent[key] = []
            continue
        own = recent.setdefault(key, [])
        own.append((r.rate, r.seconds))
        while len(own) > 2 and sum(s for _, s in own[1:]) >= 5:
            own.pop(0)
        base = max([0.0] + [v for (run, visit, _), v in want.items() if run == r.run and visit == r.visit - 1])
        found = clear(own, base) if base > 0 else None
        direct += found is not None
        if found is not None:
            want[key] = found
        elif len(own) >= 2 and sum(s for _, s in own) >= 2.5:
            want[key] = sum(v * s for v, s in own) / sum(s for _, s in own)
    got = {(r.run, r.visit, r.workers): r.rate for r in E.visit_scores(Tables(spark, sf).measurements).collect()}
    assert direct > 0
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_gates_stop_plans_with_errors(spark, sf):
    from stocktake.operators import prune
    from stocktake.sources.derived import Tables

    t = Tables(spark, sf)
    every = {r.path: r.doc_id for r in prune.candidates(t.inv_dst, t.inv_src).collect()}
    errors = t.results.filter("type = 'error'")
    stopped = {r.run for r in errors.collect()}
    want = {p for p, d in every.items() if d not in stopped}
    assert 0 < len(want) < len(every)  # some pass, some are stopped
    for name in ("g05_prune_gate_of_runs", "o08_gate_around_copy"):
        assert {r.path for r in registry.queries()[name](spark, sf).collect()} == want
    assert prune.prune_gate(prune.candidates(t.inv_dst, t.inv_src), errors).count() == 0


def test_orders_and_unions_hold_all_rows(spark, sf):
    from stocktake.sources.derived import Tables

    t = Tables(spark, sf)
    run = lambda name: registry.queries()[name](spark, sf)
    plan = {r.path: r.bytes for r in run("a01_decide_file").filter("action = 'transfer_file'").collect()}
    rows = sorted(run("o07_whole_order").collect(), key=lambda r: r.nth)
    assert [r.nth for r in rows] == list(range(1, len(plan) + 1)) and {r.path: r.bytes for r in rows} == plan
    assert [r.bytes for r in rows] == sorted(plan.values(), reverse=True)
    assert run("o03_all_markers_last").count() == t.versions.count()
    assert run("x03_whole_mapping").count() == t.mapping.count()


def test_extra_hash_is_the_librarys(spark, sf):
    import xxhash

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.queries()["x07_extra_hash"](spark, sf).collect():
        assert r.xxh3_128 == xxhash.xxh3_128_hexdigest(texts[r.doc_id].encode())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
