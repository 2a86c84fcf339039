"""Language identification: features and fitting against plain loops, accuracy on rows it never saw."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from stocktake.llm import language_id
from stocktake.llm.shingles import mixed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, place long, bucket int"


def bucket(gram):
    key = 0
    for c in gram:
        key = key << 21 | ord(c)
    return int(mixed(np.array([key + len(gram)], np.uint64))[0] >> np.uint64(48))


def counts_brute(text):
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    found = Counter()
    for i in range(len(letters)):
        for n in range(1, 4):
            gram = letters[i : i + n]
            if len(gram) == n and " " not in gram[1:-1] and gram.strip():
                found[bucket(gram)] += 1
    return found


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_ngrams(monkeypatch, piece):
    monkeypatch.setattr(language_id, "_PIECE", piece)
    for text in ("", "a", "ab", "Ab, c\n\n d-e 12f", "Éà ñ日本語 İx ẞ ", "#$ 12 \0", "x" * 50, " lead and  trail  "):
        at, n = language_id.counts(text)
        assert dict(zip(at.tolist(), n.tolist())) == counts_brute(text), text


def test_ftrl_against_plain_loops():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4).astype(np.float32), int(rng.integers(3))) for _ in range(40)]
    weights, bias = language_id.ftrl(rows, 3, width=12, alpha=0.3, beta=0.7, l1=0.2, l2=0.1, epochs=2)
    z, q = np.zeros((13, 3)), np.zeros((13, 3))

    def weight(j, c):
        l1, l2 = (0.2, 0.1) if j < 12 else (0, 0)
        return 0.0 if abs(z[j, c]) <= l1 else (math.copysign(l1, z[j, c]) - z[j, c]) / ((0.7 + math.sqrt(q[j, c])) / 0.3 + l2)

    for _ in range(2):
        for at, x, label in rows:
            full = {**dict(zip(at.tolist(), x.tolist())), 12: 1.0}
            w = {(j, c): weight(j, c) for j in full for c in range(3)}
            logits = [sum(w[j, c] * v for j, v in full.items()) for c in range(3)]
            total = sum(math.exp(v) for v in logits)
            for j, v in full.items():
                for c in range(3):
                    g = (math.exp(logits[c]) / total - (c == label)) * v
                    z[j, c] += g - (math.sqrt(q[j, c] + g * g) - math.sqrt(q[j, c])) / 0.3 * w[j, c]
                    q[j, c] += g * g
    want = np.array([[weight(j, c) for c in range(3)] for j in range(13)])
    assert np.allclose(weights, want[:12], atol=1e-4) and np.allclose(bias, want[12], atol=1e-4)
    assert 0 < (weights == 0).mean() < 1
    assert (language_id.ftrl(rows, 3, width=12, l1=1.0)[0] == 0).mean() > (weights == 0).mean()


def test_temperature_makes_probabilities_honest():
    rng = np.random.default_rng(1)
    truth = rng.normal(size=(4000, 3)) * 2
    p = np.exp(truth) / np.exp(truth).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    for factor in (0.25, 1, 6):
        assert abs(language_id.calibrated(truth * factor, labels, np.ones(4000)) / factor - 1) < 0.08
    sure = np.eye(3)[labels] * 5.0
    assert language_id.calibrated(sure, labels, np.ones(4000)) > 0.3 and language_id.calibrated(sure[:0], labels[:0], np.ones(0)) == 1


def test_unseen_rows_of_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.query(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {d for d in lang if zlib.crc32(str(d).encode()) % 3 == 1}
    unseen = [r for r in got if r.held_out]
    assert len(unseen) > 40 and sum(r.lang_pred == lang[r.doc_id] for r in unseen) >= 0.97 * len(unseen)


def test_labels_of_held_out_rows_and_other_columns_have_no_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    rows = docs.select("doc_id", "text", "lang").collect()
    plain = {tuple(r) for r in language_id.identified(docs).collect()}
    other = [(r.doc_id, r.text, "xx" if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.lang, "s", 1, 0.5, 2, 3) for r in rows]
    assert {tuple(r) for r in language_id.identified(spark.createDataFrame(other, SCHEMA).repartition(5)).collect()} == plain


def test_odd_rows(spark):
    rows = [(i, f"the of and to {'in ' * (i % 7)}", "en", None, 1, None, 1, 2) for i in range(40)] + [(i, f"der die und das {'ein ' * (i % 7)}", "de", "s", 1, None, 1, 2) for i in range(40, 80)]
    rows += [(100, None, "en", "s", 1, None, 1, 2), (101, "", "de", "s", 1, None, 1, 2), (102, "12 # $", None, "s", 1, None, 1, 2), (None, "der und das", None, "s", 1, None, 1, 2), (None, "the of and", "en", "s", 1, None, 1, 2), (103, "the of and " * 20000, None, "s", 1, None, 1, 2), (1, "the of and to", "en", None, 1, None, 1, 2)]
    got = language_id.identified(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all((by_id[d].lang_pred, by_id[d].score) == ("und", 0) for d in (100, 101, 102)) and by_id[103].lang_pred == "en"
    assert sorted((r.lang_pred, r.held_out) for r in got if r.doc_id is None) == [("de", False), ("en", False)]
    assert all(r.lang_pred == ("en" if d < 40 else "de") for d, r in by_id.items() if d < 80)
    assert language_id.identified(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = spark.createDataFrame([(1, "the of", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language_id.identified(unlabelled).collect()] == [("und", 0.0)]


def test_a_bounded_sample_still_counts_all_rows(spark):
    rows = [(i, "the of and to" if i % 4 else "der die und das", "en" if i % 4 else "de") for i in range(2000)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), sample=200)
    at = bucket("the")
    assert math.isclose(model.idf[at], math.log(2001 / 1501) + 1, rel_tol=1e-5) and model.predict("und die")[0] == "de"
