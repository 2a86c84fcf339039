"""Languages of texts: sparse multinomial logistic regression on TF-IDF of character n-grams, fitted by follow-the-regularised-leader.

Document frequencies cover all learning rows. The classifier is fitted on a sample of them, bounded
by a parameter, with elastic-net penalties that leave most weights at zero; a temperature, fitted on rows of the sample
that the weights never saw, makes its probabilities honest. Every text is scored whole, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches, table
from .shingles import mixed

#: Hash buckets of n-grams.
WIDTH = 1 << 16
#: n-grams have one to as many letters.
LONGEST = 3
#: Rows that the classifier is fitted on, about; each language has an equal part, and no fewer than LEAST where it has them.
SAMPLE, LEAST = 6000, 50
UNKNOWN = "und"
_PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's n-grams, rising, and how often each occurs, in lower case; whatever is no letter is a space, and an n-gram has spaces at its ends only.

    Without a letter there are none. Long texts are read in pieces, which share the letters that their first n-grams begin with.
    """
    text, found = f" {text.lower()} ", np.zeros(WIDTH, np.int64)
    for begin in range(0, len(text), _PIECE):
        first = max(0, begin - LONGEST + 1)
        codes = np.frombuffer(text[first : begin + _PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        codes = np.where(letter, codes, 32).astype(np.uint64)
        key, whole = np.zeros(len(codes) + 1, np.uint64), np.ones(len(codes) + 1, bool)  # whole: no space between the ends
        for n in range(1, min(LONGEST, len(codes)) + 1):
            key = key[:-1] << np.uint64(21) | codes[n - 1 :]
            whole = whole[:-1] & letter[n - 2 : -1] if n > 2 else whole[:-1]
            inner = whole.copy() if n > 2 else letter[: len(key)] | letter[n - 1 :]
            inner[: max(0, begin - first - n + 1)] = False  # those of the piece before
            found += np.bincount((mixed(key[inner] + np.uint64(n)) >> np.uint64(48)).astype(np.int64), minlength=WIDTH)
    at = np.flatnonzero(found)
    return at, found[at]


@dataclass(frozen=True)
class Model:
    """Languages, weights (bucket, language), a bias for each language, inverse document frequencies and a temperature. About WIDTH * 4 bytes for each language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language, of equal ones the first, and its probability; `und` and 0 without a letter or a language."""
        at, n = counts(text or "")
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        logits = (features(at, n, self.idf) @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        return self.languages[int(p.argmax())], float(p.max() / p.sum())


def features(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length: 1 + log of a count, times the bucket's inverse document frequency."""
    x = (1 + np.log(n)) * idf[at]
    return (x / np.sqrt(x @ x)).astype(np.float32)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, width: int = WIDTH, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width, classes) and biases of a multinomial logistic regression, by follow-the-regularised-leader over rows (buckets, values, class) in the order given.

    Each coordinate has its own rate, alpha / (beta + root of its squared gradients). l1 keeps a weight
    at zero until its gradients agree, l2 shrinks it. Biases bear no penalty.
    """
    z, squares = np.zeros((width + 1, n_classes), np.float32), np.zeros((width + 1, n_classes), np.float32)

    def weights(z: np.ndarray, squares: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(squares)) / alpha + l2), 0).astype(np.float32)

    for _ in range(epochs):
        for at, x, label in rows:
            at = np.append(at, width)
            x = np.append(x, np.float32(1))
            zs, qs = z[at], squares[at]
            w = weights(zs, qs, l1, l2)
            w[-1] = weights(zs[-1], qs[-1], 0, 0)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p[None, :]
            more = qs + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(qs)) / alpha * w
            squares[at] = more
    return weights(z[:-1], squares[:-1], l1, l2), weights(z[-1], squares[-1], 0, 0)


def calibrated(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The temperature, from 0.05 to 20, at which the labels are likeliest; 1 without rows or with one class. By golden section: the loss has one minimum in its inverse.

    Each label counts as all but one in (rows + 2), which the other classes share, so rows that are all right do not make it certain of everything.
    """
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), labels] = (n + 1) / (n + 2)

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float((weight * (np.log(np.exp(x).sum(axis=1)) - (target * x).sum(axis=1))).sum())

    low, high, ratio = np.log(0.05), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(texts: DataFrame) -> np.ndarray:
    """How many of texts(text) have each bucket; each task adds up its own."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(WIDTH, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found[counts(text or "")[0]] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["bucket", "n"])

    out = np.zeros(WIDTH, np.int64)
    table_ = texts.mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[table_["bucket"].to_numpy()] = table_["n"].to_numpy()
    return out


def fit(labelled: DataFrame, sample: int = SAMPLE, **penalties: float) -> Model:
    """A model of labelled(doc_id, text, lang); rows without a lang have no effect.

    Document frequencies and shares of languages are those of all rows. Weights are fitted on about `sample`
    rows, an equal number of each language (LEAST or more where there are so many), picked by a
    hash of doc_id and text, of which every fifth fits the temperature only; the shares of languages in all
    rows are put back into the biases. What the driver holds is bounded by `sample` rows of at most WIDTH buckets.
    Rows come in the order of their hash, so reruns and other partitions give the same model. No rows give a
    model without languages, which predicts `und`.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter("lang is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    of = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(of)
    if not languages:
        return Model([], np.zeros((WIDTH, 0), np.float32), np.zeros(0), np.ones(WIDTH))
    total = sum(of.values())
    idf = np.log((1 + total) / (1 + _document_frequencies(rows.select("text")))) + 1
    each = max(LEAST, sample // len(languages))
    bound = F.create_map(*(x for lang, n in of.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))
    picked = rows.select("lang", place.alias("place"), "text").filter(F.col("place") < bound[F.col("lang")] * float(1 << 32))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, n = counts(row["text"])
                yield pa.RecordBatch.from_pylist([{"lang": row["lang"], "place": row["place"], "bucket": at.astype(np.int32), "n": n.astype(np.int32)}], schema)

    schema = pa.schema([("lang", pa.string()), ("place", pa.int64()), ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    found = settle(picked.mapInArrow(count, "lang string, place long, bucket array<int>, n array<int>"), "sample").toArrow()
    class_of, taken = {x: i for i, x in enumerate(languages)}, []
    for i in range(found.num_rows):
        at = found["bucket"][i].values.to_numpy()
        if len(at):
            taken.append((found["place"][i].as_py(), found["lang"][i].as_py(), at, features(at, found["n"][i].values.to_numpy(), idf)))
    taken.sort(key=lambda x: x[:2])
    fitted = [(at, x, class_of[lang]) for i, (_, lang, at, x) in enumerate(taken) if i % 5]
    held = [(at, x, class_of[lang]) for i, (_, lang, at, x) in enumerate(taken) if not i % 5]
    weights, bias = ftrl(fitted, len(languages), **penalties)
    share = np.array([of[x] / total for x in languages])
    seen = np.bincount([label for *_, label in fitted], minlength=len(languages)) / max(len(fitted), 1)
    bias = bias + np.log(share) - np.log(np.maximum(seen, 1 / (1 + len(fitted))))
    labels = np.array([label for *_, label in held], np.int64)
    logits = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(-1, len(languages))
    mass = np.bincount(labels, minlength=len(languages)) / max(len(labels), 1)
    return Model(languages, weights, bias, idf.astype(np.float32), calibrated(logits, labels, (share / np.maximum(mass, 1e-12))[labels]))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs(doc_id, text), read whole; a null text counts as empty and is `und`."""
    small_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out() -> F.Column:
    """Whether CRC-32 of the decimal doc_id leaves 1 when divided by 3; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs(doc_id, text, lang): predictions by text alone of a model fitted on the rows that are not held out.

    Repeated rows are rows of their own; an empty table gives none; other columns have no effect.
    """
    rows = docs.select("doc_id", "text", "lang")
    found = predicted(rows, fit(rows.filter(~held_out()), sample))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
