"""Each stage of the pipeline against what its operator decides, and the whole run."""

import random
import zlib
from collections import Counter

import corpus_pipeline
from test_operators import near_brute

from stocktake.llm import bin_completion, common, line_dedup, quality_rules, source_mix


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "source_mix", "best_fit_packing"]
    step = {n: f for n, f in corpus_pipeline.STAGES}

    good = step["quality_rules"](spark, docs, sf)
    kept = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(kept)
    good = spark.createDataFrame(good.collect(), docs.schema)

    cut = step["line_dedup"](spark, good, sf)
    gone = {r.doc_id: set(r.dropped) for r in line_dedup.dropped_lines(good).collect()}
    want = {}
    for r in good.collect():
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id])
        if text.split() or not gone[r.doc_id]:
            want[r.doc_id] = (text, r.lang, r.source, len(text))
    assert cut.columns == columns and {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in cut.collect()} == want
    cut = spark.createDataFrame(cut.collect(), docs.schema)

    one = step["minhash_dedup"](spark, cut, sf)
    left = {d for d, (_, _, kept) in near_brute([(r.doc_id, r.text) for r in cut.collect()]).items() if kept}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == left
    one = spark.createDataFrame(one.collect(), docs.schema)

    mixed = step["source_mix"](spark, one, sf)
    copies = {r.doc_id: r.copies for r in source_mix.mix(one).collect()}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in copies.items() if n})
    mixed = spark.createDataFrame(mixed.collect(), docs.schema)

    packed = step["best_fit_packing"](spark, mixed, sf).collect()
    whole = bin_completion.pieces(mixed, bin_completion.path_of("word_bpe_49k.json"), False, 1, 4096).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole)
    assert zlib.crc32(b"") == 0 and len({r.sequence_id for r in packed}) >= -(-sum(r.length for r in packed) // 4096)


def test_null_and_clashing_columns(spark, sf):
    rows = [(None, None, None, None, None, "a"), (1, "some words in a text " * 12, "en", "s", 5, "b"), (2, "", None, "s", None, "c"), (3, "Other words, which stay here as they are in this text for all to see and to read at night by the lamp.", "en", None, 7, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, dropped string")
    for docs_ in (docs, docs.limit(0)):
        step = docs_
        for _, f in corpus_pipeline.STAGES[:-1]:
            step = f(spark, step, sf)
            assert step.columns == docs.columns
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, step, sf).collect()} <= {3}


def test_missing_and_repeated_ids_through_all_stages(spark, sf):
    def text(seed):
        r = random.Random(seed)
        words = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8))) for _ in range(160)]
        return "\n".join("The " + " ".join(words[i : i + 10]) + " and the rest of it." for i in range(0, 160, 10))

    shared = "This line stands in both rows without an id."
    one, other, third, fourth = text(1), text(2), text(3), text(4)
    rows = [(None, one + "\n" + shared), (None, shared + "\n" + other), (7, third), (7, third), (7, fourth), (8, text(5)), (None, fourth)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    step = dict(corpus_pipeline.STAGES)

    cut = step["line_dedup"](spark, docs, sf).collect()
    whole = sorted({x for _, t in rows for x in t.split("\n")})
    assert sorted(x for r in cut for x in r.text.split("\n")) == whole
    assert Counter(r.doc_id for r in cut) == {None: 2, 7: 2, 8: 1}

    left = step["minhash_dedup"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in left) == {None: 2, 7: 2, 8: 1}
    assert {r.text for r in left} == {t for _, t in rows}

    distinct = spark.createDataFrame(left, docs.schema)
    copies = Counter(r.text for r in step["source_mix"](spark, distinct, sf).collect())
    own = common.own_ids(distinct)
    of = {r.doc_id: r.text for r in own.collect()}
    assert len(of) == 5 and copies == Counter({of[r.doc_id]: r.copies for r in source_mix.mix(own).collect() if r.copies})
    packed = step["best_fit_packing"](spark, distinct, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == {None: 2, 7: 2, 8: 1}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
