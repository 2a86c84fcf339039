"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation weighs them, the posterior decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, small_batches, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_MORE = "n_lines long, n_letters long, n_capitals long, n_closed_lines long, n_stutters long"
#: What a line of prose ends with.
_CLOSERS = (".", "!", "?", "…", '"', "'", ")", "»", "”", ":", ";", ",")


def text_stats(text: str) -> tuple[int, ...]:
    """The values of _BASE and _MORE for one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    word_chars = len(text) - len(data) + sum(map(len, words))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n_dup = len(lines) - len(set(lines))
    values = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeated = 0
    if n > WINDOW:
        windows = np.zeros(n - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + values[j : n - WINDOW + 1 + j]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            often = np.zeros(n - WINDOW + 1, bool)
            often[order[1:][same]] = True
            often[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.flatnonzero(often), 1)
            np.add.at(edge, np.flatnonzero(often) + WINDOW, -1)
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    letters = np.frombuffer(data, np.uint8)
    capitals = int(((letters >= 65) & (letters <= 90)).sum())
    n_letters = capitals + int(((letters >= 97) & (letters <= 122)).sum())
    closed = sum(x.rstrip().endswith(_CLOSERS) for x in lines)
    return n, word_chars, n_symbols, n_dup, repeated, len(lines), n_letters, capitals, closed, int((values[1:] == values[:-1]).sum())


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and text_stats of docs(doc_id, text); a null text counts as empty."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in f"{_BASE}, {_MORE}".split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_stats(t or "") for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(names)))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id long, {_BASE}, {_MORE}")


def rules(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Each rule votes 1 (good), -1 (odd), -2 (bad) or 0 (abstains); of gives the statistics of _BASE and _MORE by name."""
    ratio = lambda a, b: of(a) / F.greatest(of(b), F.lit(1))
    grade = lambda good, odd: F.when(good, 1).when(odd, -1).otherwise(-2)
    where = lambda known, vote: F.when(known, vote).otherwise(0)
    upto = lambda x, good, odd: grade(x <= good, x <= odd)
    long, word, closed = of("n_words") >= 16, ratio("word_chars", "n_words"), ratio("n_closed_lines", "n_lines")
    return {
        "word_length": where(of("n_words") >= 5, grade(word.between(3.5, 8), word.between(2.5, 12))),
        "symbols": upto(ratio("n_symbols", "n_words"), 0.02, 0.2),
        "capitals": where(of("n_letters") > 20, upto(ratio("n_capitals", "n_letters"), 0.15, 0.4)),
        "repeated_lines": where(of("n_lines") >= 4, upto(ratio("n_dup_lines", "n_lines"), 0.25, 0.5)),
        "repeated_words": where(long, upto(ratio("n_repeat_words", "n_words"), 0.12, 0.3)),
        "stutter": where(long, upto(ratio("n_stutters", "n_words"), 0.05, 0.3)),
        "line_ends": where(of("n_lines") >= 3, grade(closed >= 0.6, closed >= 0.2)),
        "line_length": where(of("n_words") >= 50, F.when(ratio("n_words", "n_lines") <= 250, 1).otherwise(-1)),
    }


_VOTES = (-2, -1, 1)


@dataclass(frozen=True)
class LabelModel:
    """One class of good documents, the first, and some kinds of bad ones: the share of each, and for each rule and class P(vote | class, the rule votes) of the votes -2, -1, 1.

    A rule that abstains says nothing, in the estimates as in the posterior. loss: the negative log-likelihood of a document by round.
    """

    shares: np.ndarray
    rates: np.ndarray  # rule, class, vote
    loss: tuple[float, ...] = ()

    @property
    def prior(self) -> float:
        """The share of good documents."""
        return float(self.shares[0])

    @property
    def given_good(self) -> np.ndarray:
        """For each rule P(bad or odd), 0 and P(good vote) for a good document, all a little above 0."""
        return _plain(self.rates[:, 0])

    @property
    def given_bad(self) -> np.ndarray:
        """The same for a bad document of any kind."""
        of = self.shares[1:] / self.shares[1:].sum()
        return _plain(np.einsum("k,rkv->rv", of, self.rates[:, 1:]))

    def logs(self, votes: np.ndarray) -> np.ndarray:
        """log P(class, votes) for each row of votes."""
        out = np.tile(np.log(self.shares), (len(votes), 1))
        for r in range(votes.shape[1]):
            for i, v in enumerate(_VOTES):
                out[votes[:, r] == v] += np.log(self.rates[r, :, i])
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes) for each row of votes."""
        return _normalised(self.logs(votes))[0][:, 0]


def _plain(rates: np.ndarray) -> np.ndarray:
    tiny = 1e-9
    return np.stack([rates[:, 0] + rates[:, 1], np.full(len(rates), tiny), rates[:, 2]], axis=1) / (1 + tiny)


def _normalised(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of exp(logs) that sum to 1, and the logs of their sums."""
    top = logs.max(axis=1, keepdims=True)
    e = np.exp(logs - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def fit(votes: np.ndarray, counts: np.ndarray, prior: float = 0.85, rounds: int = 80, pseudo: float = 2.0) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and how many documents have each.

    Documents are bad in different ways, so there is a kind of bad ones for each rule that votes -2 at all (one kind
    where none does): what fails one rule mostly passes the others, which a single class of bad ones can't express. A first guess
    deals documents by their votes of -2, or by several of -1. Each round estimates all rates and
    shares from the posteriors of the round before. Rates begin at `pseudo` votes, at each rule's own mix, and shares at `pseudo` documents at
    the prior: a handful, however many documents there are, so the data decide. The good class is the one whose good votes are
    the likeliest on most rules.
    """
    n_rules, total = votes.shape[1], counts.sum()
    strong = [r for r in range(n_rules) if (votes[:, r] == -2).any()]
    k = 1 + max(len(strong), 1)
    start = np.r_[prior, np.full(k - 1, (1 - prior) / (k - 1))]
    mix = np.array([[1 + counts[votes[:, r] == v].sum() for v in _VOTES] for r in range(n_rules)])
    mix = mix / mix.sum(axis=1, keepdims=True)
    model = LabelModel(start, np.repeat(mix[:, None], k, axis=1))
    if not total:
        return model
    bad, odd = (votes == -2).sum(axis=1), (votes == -1).sum(axis=1)
    of = np.where(bad > 0, 0.9, np.where(odd >= 3, 0.5, 0.1)) if strong else np.where(odd >= 2, 0.9, np.where(odd == 1, 0.5, 0.1))
    kinds = np.where(bad[:, None] > 0, (votes[:, strong] == -2) / np.maximum(bad, 1)[:, None], 1 / (k - 1)) if strong else np.ones((len(votes), 1))
    p, losses = np.column_stack([1 - of, kinds * of[:, None]]), []
    for _ in range(rounds):
        w = p * counts[:, None]
        shares = (w.sum(axis=0) + pseudo * start) / (total + pseudo)
        rates = np.array([[w[votes[:, r] == v].sum(axis=0) for v in _VOTES] for r in range(n_rules)]).transpose(0, 2, 1) + pseudo * mix[:, None]
        model = LabelModel(shares, rates / rates.sum(axis=2, keepdims=True))
        p, logs = _normalised(model.logs(votes))
        losses.append(-float((counts * logs).sum() / total))
    best = int(np.bincount(model.rates[:, :, 2].argmax(axis=1), minlength=k).argmax()) if strong == [] else 0
    order = [best, *(i for i in range(k) if i != best)]
    return LabelModel(model.shares[order], model.rates[:, order], tuple(losses))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base statistics, base_failed, quality (posterior probability of good) and kept for each row of docs(doc_id, text).

    Rules vote, expectation-maximisation (fit) estimates how they err, and the posterior
    decides. Only the counts of vote patterns (at most 4 to the number of rules) reach the
    driver; they cover all documents. A null or empty text has no words and fails.
    A null doc_id and rows that repeat are documents of their own; an empty table
    gives no rows.
    """
    stats = settle(with_stats(docs), "quality")
    votes, counts = _patterns(stats)
    failed, quality = _verdict(fit(votes, counts), votes, F.col)
    base = [x.split()[0] for x in _BASE.split(", ")]
    return stats.select("doc_id", *base, failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= threshold)).alias("kept"))


def _patterns(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vote patterns of all rows of with_stats, and how many rows have each."""
    named = rules()
    patterns = stats.select(*(v.alias(k) for k, v in named.items())).groupBy(*named).agg(F.count("*").alias("n")).collect()
    return np.array([[r[c] for c in named] for r in patterns], np.int64).reshape(-1, len(named)), np.array([r.n for r in patterns], float)


def fitted(stats: DataFrame) -> LabelModel:
    """The label model of the vote patterns of all rows of with_stats."""
    return fit(*_patterns(stats))


def _verdict(model: LabelModel, votes: np.ndarray, of: Callable[[str], Column]) -> tuple[Column, Column]:
    """base_failed and quality, which is looked up by the row's vote pattern, one of `votes`: each rule is evaluated once for a row."""
    digits = 4 ** np.arange(votes.shape[1])
    code = sum(((vote + 2) * int(d) for vote, d in zip(rules(of).values(), digits)), F.lit(0))
    known = zip(((votes + 2) @ digits).tolist(), model.posterior(votes).tolist())
    quality = F.try_element_at(F.create_map(*(F.lit(x) for pair in known for x in pair)), code.cast("long")) if len(votes) else F.lit(None).cast("double")
    failed = (of("n_words") < 20) | (100 * of("n_repeat_words") > 30 * of("n_words"))
    return failed, quality


def kept_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge keeps, all columns; the verdict is found beside each row, so texts are not shuffled."""
    votes, counts = _patterns(settle(with_stats(docs), "quality"))
    names = [x.split()[0] for x in f"{_BASE}, {_MORE}".split(", ")]
    at, columns, beside_ = docs.columns.index("text"), docs.columns, "stats"
    while beside_ in columns:
        beside_ += "_"

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_stats(t or "") for t in batch.column(at).to_pylist()], np.int64).reshape(-1, len(names))
            stats = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(names))], names)
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], names=[*columns, beside_])

    schema = T.StructType([*docs.schema, T.StructField(beside_, T.StructType([T.StructField(n, T.LongType()) for n in names]))])
    failed, quality = _verdict(fit(votes, counts), votes, lambda n: F.col(f"{beside_}.{n}"))
    return docs.mapInArrow(beside, schema).filter(~failed & (quality >= threshold)).drop(beside_)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
