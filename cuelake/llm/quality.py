"""Quality by a linear-chain conditional random field over the lines of a document.

Every line that isn't blank has features of its own and of its two neighbours. The chain labels
each line good or bad; forward-backward gives the probability of good, and the mean over the
lines, weighted by their length, is the quality of the document, brought to a probability by a
logistic fit on the training documents.

A text without a visible line (null, empty, blank) gets the share of good training documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, bucket_of, mapped, mix64, word_hashes

#: The fit's bounds: labelled documents, and lines of each that the chain is trained on. Of a document with more lines, whole stretches of
#: lines are drawn by a hash, over all of its text. So the driver holds TRAINING_DOCS * LINES_EACH rows of 73 numbers at most: 56 MB.
TRAINING_DOCS = 3000
LINES_EACH, STRETCH = 64, 16
STEPS, RATE, PENALTY = 200, 0.1, 1e-3

#: Byte classes: 0 other letters (over 127), 1 lower case, 2 upper case, 3 digit, 4 white space, 5 usual marks, 6 exclamation, 7 other signs.
CLASS = np.full(256, 7, dtype=np.uint8)
CLASS[128:] = 0
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[[9, 10, 11, 12, 13, 32]] = 4
CLASS[list(b".,;:'\"()-?")] = 5
CLASS[ord("!")] = 6
CLASSES = 8
BASE = 24


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each visible line with those of its neighbours, length of each, lines of each text)."""
    joined = b"\n".join(texts) + b"\n"
    b = np.frombuffer(joined, dtype=np.uint8)
    kind = CLASS[b]
    ends = np.flatnonzero(b == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    counts = np.zeros((len(starts), CLASSES))
    long_starts = starts  # every line holds at least its line feed
    for k in range(CLASSES):
        counts[:, k] = np.add.reduceat((kind == k).astype(np.int64), long_starts)
    counts[:, 4] -= 1
    n = ends - starts
    seen = n > counts[:, 4]
    starts, ends, owner, counts, n = starts[seen], ends[seen], owner[seen], counts[seen], n[seen].astype(float)
    if not len(starts):
        return np.zeros((0, 3 * BASE + 1), dtype=np.float32), np.zeros(0), np.bincount(owner, minlength=len(texts))
    letters = counts[:, 0] + counts[:, 1] + counts[:, 2]
    digest = np.array([hash(joined[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    same = pd.DataFrame({"o": owner, "d": digest})
    repeated = same.duplicated(keep=False).to_numpy(dtype=float)
    before = np.concatenate([[False], (digest[1:] == digest[:-1]) & (owner[1:] == owner[:-1])]).astype(float)
    words = counts[:, 4] + 1
    at, _, word = word_hashes(b)
    line = np.searchsorted(starts, at, side="right") - 1
    again = []
    for lag in (1, 2, 16):  # words that come again so many words later in the line
        hit = (word[lag:] == word[:-lag]) & (line[lag:] == line[:-lag])
        again.append(np.bincount(line[lag:][hit], minlength=len(starts)) / words)
    again.append(np.minimum(1, 5 * again[0]))
    ratio = [counts[:, 2] / (letters + 1), counts[:, 3] / n, counts[:, 7] / n, counts[:, 5] / n, counts[:, 6] / n]
    own = np.stack([
        np.log1p(n) / 6, np.minimum(n / 40, 1), (n - counts[:, 4]) / words / 10, counts[:, 4] / n, letters / n, counts[:, 0] / n,
        np.isin(b[ends - 1], list(b".!?")).astype(float), (kind[starts] == 2).astype(float), repeated, before, *ratio, *[np.minimum(10 * r, 1) for r in ratio], *again,
    ], axis=1).astype(np.float32)
    previous, following = np.zeros_like(own), np.zeros_like(own)
    inside = owner[1:] == owner[:-1]
    previous[1:][inside] = own[:-1][inside]
    following[:-1][inside] = own[1:][inside]
    return np.concatenate([own, previous, following, np.ones((len(own), 1), dtype=np.float32)], axis=1), n, np.bincount(owner, minlength=len(texts))


def marginals(unary: np.ndarray, counts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line by forward-backward, and the expected moves; unary: log-odds of good, lines of a document in a row.

    All chains advance side by side; those that have ended leave the front.
    """
    order = np.argsort(-counts, kind="stable")
    first = (counts.cumsum() - counts)[order]
    lengths = counts[order]
    most = int(lengths[0]) if len(lengths) else 0
    going = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")
    e = np.stack([np.zeros_like(unary), unary], axis=1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    m = np.exp(move)
    forward, backward = np.empty((len(unary), 2)), np.ones((len(unary), 2))
    for t in range(most):
        at = first[: going[t]] + t
        a = e[at] if t == 0 else (forward[at - 1] @ m) * e[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    moves = np.zeros((2, 2))
    for t in range(most - 1, 0, -1):
        at = first[: going[t]] + t
        right = e[at] * backward[at]
        pair = forward[at - 1][:, :, None] * m * right[:, None, :]
        moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = right @ m.T
        backward[at - 1] = back / back.sum(axis=1, keepdims=True)
    p = forward * backward
    return (p[:, 1] / p.sum(axis=1)), moves


def fit_chain(x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves by gradient ascent on the likelihood of line labels that follow the document's."""
    y = np.repeat(labels, counts)
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = np.maximum(counts[labels == k] - 1, 0).sum()
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    weight = 1 / max(len(x), 1)
    for step in range(1, STEPS + 1):
        p, moves = marginals(x @ w, counts, move)
        grads = [((y - p) @ x) * weight - PENALTY * w, (seen - moves) * weight - PENALTY * move]
        for k, (value, g) in enumerate(zip((w, move), grads, strict=True)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g * g
            value += RATE * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
    return w, move


def document_logits(p: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-odds of the length-weighted mean of the lines' probabilities; NaN where a document has no line."""
    owner = np.repeat(np.arange(len(counts)), counts)
    size = np.bincount(owner, weights=n, minlength=len(counts))
    mean = np.bincount(owner, weights=n * p, minlength=len(counts)) / np.where(size > 0, size, np.nan)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit_logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        s = p * (1 - p) + 1e-6
        g = np.array([((y - p) * z).sum() - 1e-2 * (a - 1), (y - p).sum()])
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def drawn(text: bytes, lines: int) -> list[tuple[int, int]]:
    """The lines of a text that train: all, or stretches of it up to LINES_EACH lines."""
    if lines <= LINES_EACH:
        return [(0, lines)] if lines else []
    rank = mix64(np.arange(-(-lines // STRETCH), dtype=np.uint64) + np.uint64(zlib.crc32(text) << 20))
    return [(k * STRETCH, min(lines, (k + 1) * STRETCH)) for k in sorted(np.argsort(rank)[: LINES_EACH // STRETCH].tolist())]


def build(x: np.ndarray, n: np.ndarray, chains: list[list[int]], labels: np.ndarray) -> dict:
    """The model from the lines of documents; chains: the lengths of each document's stretches."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(x) or share in (0.0, 1.0):
        return {"constant": share}
    lengths = np.array([c for own in chains for c in own], dtype=np.int64)
    w, move = fit_chain(x.astype(np.float64), lengths, np.repeat(labels, [len(own) for own in chains]))
    z = document_logits(marginals(x @ w, lengths, move)[0], n, np.array([sum(own) for own in chains], dtype=np.int64))
    seen = ~np.isnan(z)
    a, b = fit_logistic(z[seen], labels[seen].astype(float))
    return {"w": w, "move": move, "a": a, "b": b, "constant": share}


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    out = np.full(len(texts), model["constant"])
    if "w" not in model:
        return out
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < 1 << 20:
            size += len(texts[end])
            end += 1
        x, n, counts = line_features(texts[at:end])
        if len(x):
            z = document_logits(marginals(x @ model["w"], counts, model["move"])[0], n, counts)
            p = 1 / (1 + np.exp(-np.clip(model["a"] * z + model["b"], -500, 500)))
            out[at:end] = np.where(np.isnan(z), out[at:end], p)
        at = end
    return out


def held_out(id_col: str = "doc_id"):
    return bucket_of(id_col, 3) == 1


def fit(documents: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS) -> dict:
    """Train on training_docs labelled documents at most that aren't held out, chosen by a hash of the id, and on LINES_EACH lines of each at most.

    These bounds keep what comes to the driver, and the labels that are broadcast, small at any input and however long documents are.
    """
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = own.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(training_docs)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "quality")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, out = [as_bytes(t) for t in batch["text"]], []
            for key, text, quality in zip(batch["doc_id"], texts, batch["quality"], strict=True):
                x, n, _ = line_features([text])
                own = drawn(text, len(n))
                pick = np.concatenate([np.arange(a, b) for a, b in own]) if own else np.zeros(0, dtype=np.int64)
                out.append((key, int(quality), x[pick].tobytes(), n[pick].tobytes(), [b - a for a, b in own]))
            yield pd.DataFrame(out, columns=["doc_id", "quality", "x", "n", "chains"])

    got = mapped(rows, run, "doc_id string, quality int, x binary, n binary, chains array<int>").toArrow().to_pandas().sort_values(["doc_id", "x"], ignore_index=True)
    x = [np.frombuffer(r, dtype=np.float32).reshape(-1, 3 * BASE + 1) for r in got["x"]]
    n = [np.frombuffer(r) for r in got["n"]]
    return build(np.concatenate(x) if x else np.zeros((0, 3 * BASE + 1)), np.concatenate(n) if n else np.zeros(0), [list(c) for c in got["chains"]], got["quality"].to_numpy(dtype=np.int64))


def score_documents(documents: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents, in one narrow pass after the fit.

    Repeated rows each get the same score, equal texts equal scores; a null id is not held out; of several labels of one id the largest counts;
    without labels of both kinds every score is the share of good ones, 0.5 without any. An empty table gives an empty result; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = score_texts(shared.value, [as_bytes(t) for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "held_out": batch["held_out"].to_numpy(), "score": score, "predicted": (score >= 0.5).astype(int)})

    kind = dict(documents.dtypes)["doc_id"]
    return mapped(documents.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")
