"""The chain of op2 against all labellings, and what its fit may hold."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import quality


@pytest.mark.parametrize("seed", range(5))
def test_marginals_against_all_labellings(seed):
    """P(good) of each line and the expected moves, summed over every labelling of every chain."""
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 9, size=6)
    unary, move = rng.normal(size=counts.sum()) * 3, rng.normal(size=(2, 2)) * 2
    p, moves = quality.marginals(unary, counts, move)
    expected, at, pairs = [], 0, np.zeros((2, 2))
    for n in counts:
        own, good, between, total = unary[at : at + n], np.zeros(n), np.zeros((2, 2)), 0.0
        for labels in product((0, 1), repeat=int(n)):
            weight = np.exp(sum(u for u, y in zip(own, labels, strict=True) if y) + sum(move[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            total += weight
            good += weight * np.array(labels)
            for a, b in zip(labels, labels[1:], strict=False):
                between[a, b] += weight
        expected += (good / total).tolist()
        pairs += between / total
        at += n
    assert np.allclose(p, expected, atol=1e-12) and np.allclose(moves, pairs, atol=1e-12)


def test_fit_climbs_the_likelihood():
    """The weights are where the gradient of the likelihood, taken by differences over all labellings, is that of the penalty."""
    rng = np.random.default_rng(3)
    counts, labels = np.array([3, 4, 2, 5]), np.array([1, 0, 1, 0])
    x = rng.normal(size=(14, 3)) + np.repeat(labels, counts)[:, None]

    def gain(w, move):
        y, at, out = np.repeat(labels, counts), 0, 0.0
        for n, label in zip(counts, labels, strict=True):
            unary = x[at : at + n] @ w
            norm = sum(np.exp(sum(u for u, k in zip(unary, ys, strict=True) if k) + sum(move[a, b] for a, b in zip(ys, ys[1:], strict=False))) for ys in product((0, 1), repeat=int(n)))
            out += (unary * y[at : at + n]).sum() + (n - 1) * move[label, label] - np.log(norm)
            at += n
        return out / len(x) - quality.PENALTY / 2 * ((w**2).sum() + (move**2).sum())

    w, move = quality.fit_chain(x, counts, labels)
    best = gain(w, move)
    assert best > gain(np.zeros(3), np.zeros((2, 2))) + 0.1
    for _ in range(20):
        assert gain(w + rng.normal(size=3) * 0.5, move + rng.normal(size=(2, 2)) * 0.5) < best + 1e-3


@pytest.mark.parametrize("lines", [0, 1, 63, 64, 65, 100, 5000, 1_000_000])
def test_lines_that_train(lines):
    own = quality.drawn(b"text", lines)
    assert sum(b - a for a, b in own) == lines if lines <= quality.LINES_EACH else quality.LINES_EACH - quality.STRETCH < sum(b - a for a, b in own) <= quality.LINES_EACH
    assert all(0 <= a < b <= lines for a, b in own) and own == sorted(own)
    if lines == 1_000_000:  # drawn from all of the text
        assert max(a for k in range(20) for a, _ in quality.drawn(b"%d" % k, lines)) > lines * 0.8


def test_a_long_document_does_not_fill_the_driver(spark, monkeypatch):
    """A labelled document of 50,000 lines brings LINES_EACH rows."""
    seen = []
    build = quality.build
    monkeypatch.setattr(quality, "build", lambda x, n, chains, labels: seen.append((len(x), len(n), sum(map(sum, chains)))) or build(x, n, chains, labels))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 6, F.repeat(F.lit("A line of words, it is.\n"), 50_000)).otherwise(F.concat(F.lit("Some text, number "), "id", F.lit("."))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 40 and seen[0][0] == seen[0][1] == seen[0][2] <= 40 + quality.LINES_EACH
