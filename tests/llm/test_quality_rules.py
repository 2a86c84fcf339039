"""The label model of quality rules: rounds raise the likelihood, no vote is fatal by itself, the prior hardly matters."""

import numpy as np
import pytest

from stocktake.llm import quality_rules


@pytest.fixture(scope="module")
def table(spark):
    """Vote patterns, their counts, base failures and labels of all rows of the largest given table."""
    folder = "/root/testdata/sf0.1"
    stats = quality_rules.with_stats(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = stats.select("doc_id", *(v.alias(k) for k, v in quality_rules.rules().items()), ((stats.n_words < 20) | (100 * stats.n_repeat_words > 30 * stats.n_words)).alias("failed")).collect()
    votes = np.array([list(r)[1:-1] for r in rows])
    return votes, np.array([r.failed for r in rows]), np.array([labels.get(r.doc_id, -1) for r in rows])


def fitted(votes, **how):
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality_rules.fit(patterns, counts.astype(float), **how)
    return model, model.posterior(patterns)[at.ravel()]


def test_rounds_matter_and_raise_the_likelihood(table):
    votes, failed, labels = table
    model, good = fitted(votes)
    assert all(b <= a + 1e-4 for a, b in zip(model.loss, model.loss[1:])) and model.loss[-1] < model.loss[0] - 0.05
    one, first = fitted(votes, rounds=1)
    assert ((first >= 0.5) != (good >= 0.5)).sum() > 0 and np.abs(one.rates - model.rates).max() > 0.1
    known = labels >= 0
    assert (((good >= 0.5) & ~failed)[known] == (labels[known] == 1)).mean() > 0.97


def test_no_vote_decides_alone(table):
    votes, failed, _ = table
    model, good = fitted(votes)
    kept = (good >= 0.5) & ~failed
    assert ((votes < 0).any(axis=1) & kept).sum() > 20  # a vote against is overruled
    assert (~(votes == -2).any(axis=1) & (good < 0.5) & ~failed).sum() > 3  # odd votes add up
    # even a vote of -2 is overruled where other rules know better: kinds of bad documents that hardly occur carry little
    assert (model.shares[1:] > 0).all()
    everything_good = np.ones((1, votes.shape[1]), int)
    assert model.posterior(everything_good)[0] > 0.95 and model.posterior(everything_good * -2)[0] < 0.01


def test_the_prior_hardly_matters(table):
    votes, _, _ = table
    kept = {p: fitted(votes, prior=p)[1] >= 0.5 for p in (0.5, 0.7, 0.85, 0.95)}
    for p in kept:
        assert (kept[p] == kept[0.85]).mean() > 0.99
    often = fitted(np.repeat(votes, 3, axis=0))[1] >= 0.5
    assert (often[::3] == kept[0.85]).mean() > 0.99  # more of the same rows: what is added to the counts does not grow with them


def test_kinds_of_bad_documents_are_told_apart():
    r = np.random.default_rng(4)
    n = 30000
    kind = r.choice(4, n, p=[0.8, 0.1, 0.06, 0.04])
    rates = np.full((4, 5, 3), [0.01, 0.03, 0.96])
    rates[:, 3:] = [0.0, 0.04, 0.96]
    for k in (1, 2, 3):
        rates[k, k - 1] = [0.9, 0.05, 0.05]
    votes = np.array([[r.choice([-2, -1, 1], p=rates[k, j]) for j in range(5)] for k in kind])
    votes[r.random(votes.shape) < 0.2] = 0
    model, good = fitted(votes)
    best = quality_rules.LabelModel(np.array([0.8, 0.1, 0.06, 0.04]), np.maximum(rates.transpose(1, 0, 2), 1e-6)).posterior(votes)
    right = lambda p: ((p >= 0.5) == (kind == 0)).mean()
    assert abs(model.prior - 0.8) < 0.08 and right(good) > right(best) - 0.005  # as good as the rates that made the votes
    assert np.abs(model.rates[:, 0] - rates[0]).max() < 0.05
