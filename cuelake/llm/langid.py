"""Language identification by word-first backoff.

A word that the model knows adds its log frequency in each language. An unseen word is cut into
character n-grams, with marks for its ends, of the longest length first; the first length of
which the model knows a gram gives the mean log frequency of the known ones, weighted less the
shorter they are. The language with the highest sum wins (ties: the first by name); the score is the
softmax of the sums divided by the square root of the number of words.

Words are runs of letters, lower case. Words and n-grams are counted and looked up by 64-bit hashes of their
code points, many texts at once. The model holds every word and n-gram of its sample.

Texts that are null or have no letter are `und` with score 0, and so are all where no row to learn from
has a lang. Repeated rows count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import as_text, bucket_of, code_point_classes, code_points, mapped, mix64, powers

LETTERS = (r"\p{L}+",)
LONGEST = 5
#: The fit's bound: expected documents of each language.
DOCS_PER_LANGUAGE = 1500
STEP_CHARS = 1 << 20
#: Code points of the marks at the ends of a word, which no letter has.
BEGIN, END = 1, 2
UNKNOWN = "und"
_SPREAD = 0xD6E8FEB86659FD93


class Words:
    """The words of some texts set side by side: code points, and for each word its text, first character, size and hash."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        self.points = code_points("\n".join(lowered)).astype(np.uint64)
        inside = np.concatenate([[False], code_point_classes(LETTERS)[self.points.astype(np.int64)] > 0, [False]])
        self.starts = np.flatnonzero(~inside[:-1] & inside[1:])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        self.sizes = ends - self.starts
        up, down = powers(len(self.points) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), (self.points * up[: len(self.points)]).cumsum(dtype=np.uint64)])
        self.hashes = mix64((sums[ends] - sums[self.starts]) * down[self.starts] + self.sizes.astype(np.uint64) * np.uint64(_SPREAD))
        first = np.cumsum([0, *(len(t) + 1 for t in lowered)])[:-1]
        self.texts = np.searchsorted(first, self.starts, side="right") - 1


def marked(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some words with marks at both ends, in turn: (code points, place of the word in `which`, characters from here to the word's end)."""
    sizes = words.sizes[which] + 2
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(which)), sizes)
    at = np.arange(len(of)) - (ends - sizes)[of]
    points = words.points[np.clip(words.starts[which][of] + at - 1, 0, max(len(words.points) - 1, 0))]
    points[at == 0] = BEGIN
    points[at == sizes[of] - 1] = END
    return points, of, sizes[of] - at


def gram_hashes(points: np.ndarray, of: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of every n-gram; single characters without the marks."""
    where = np.flatnonzero(room >= n if n > 1 else points > END)
    own = np.zeros(len(where), dtype=np.uint64)
    for k in range(n):
        own = own * np.uint64(0x9E3779B97F4A7C15) + points[where + k] + np.uint64(1)
    return mix64(own + np.uint64(n * _SPREAD & (1 << 64) - 1)), of[where]


def steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of texts with STEP_CHARS characters at most, or one text."""
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end]) <= STEP_CHARS):
            chars += len(texts[end])
            end += 1
        yield start, end
        start = end


def count_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words (n = 0) and n-grams by language, counted within each stretch of texts."""
    for batch in batches:
        for lang, part in batch.groupby("lang", sort=False):
            texts = [as_text(t) for t in part["text"]]
            for start, end in steps(texts):
                words = Words(texts[start:end])
                own, first, times = np.unique(words.hashes, return_index=True, return_counts=True)
                yield pd.DataFrame({"lang": lang, "n": 0, "gram": own.astype(np.int64), "k": times})
                cut = marked(words, first)
                for n in range(1, LONGEST + 1):
                    hashes, of = gram_hashes(*cut, n)
                    own, inverse = np.unique(hashes, return_inverse=True)
                    yield pd.DataFrame({"lang": lang, "n": n, "gram": own.astype(np.int64), "k": np.bincount(inverse, weights=times[of], minlength=len(own)).astype(np.int64)})


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> dict:
    """Count the words and n-grams of a sample of rows (doc_id, text, lang), chosen by a hash of id and text.

    The sample holds about docs_per_language rows of each language; what comes to the driver is
    bounded by the words and n-grams of the sample.
    """
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return build([], [], [], [], [])
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / n)))])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    langs = sorted(sizes)
    place = F.create_map(*[x for k, lang in enumerate(langs) for x in (F.lit(lang), F.lit(k))])
    counted = mapped(sample.select("lang", "text"), count_partition, "lang string, n int, gram long, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    found = counted.select(place[F.col("lang")].alias("lang"), "n", "gram", "k").toArrow()
    return build(langs, *(found[c].to_numpy() for c in ("lang", "n", "gram", "k")))


def build(langs: list[str], lang, n, gram, k) -> dict:
    """Log frequencies with add-a-half smoothing: for words and for each length of n-grams sorted hashes, and a row of numbers for each."""
    lang, n, gram, k = (np.asarray(x) for x in (lang, n, gram, k))
    keys, logs = [], []
    for length in range(LONGEST + 1):
        own = n == length
        hashes, row = np.unique(gram[own].astype(np.int64).view(np.uint64), return_inverse=True)
        counts = np.zeros((len(hashes), max(len(langs), 1)), dtype=np.float64)
        counts[row, lang[own].astype(np.int64)] = k[own]
        kinds = int((counts > 0).sum(axis=0).max()) if len(hashes) else 0
        keys.append(hashes)
        logs.append(np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * kinds + 1)).astype(np.float32))
    return {"langs": langs, "keys": keys, "logs": logs}


class Identifier:
    def __init__(self, model: dict):
        self.langs, self.keys, self.logs = model["langs"], model["keys"], model["logs"]

    def find(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash in the table of length n, or -1."""
        keys = self.keys[n]
        if not len(keys):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def unseen(self, words: Words, which: np.ndarray) -> np.ndarray:
        """What words that the model lacks add: a row for each."""
        out = np.zeros((len(which), len(self.langs)), dtype=np.float32)
        open_ = np.arange(len(which))
        for n in range(LONGEST, 0, -1):
            if not len(open_):
                break
            hashes, of = gram_hashes(*marked(words, which[open_]), n)
            row = self.find(n, hashes)
            of, row = of[row >= 0], row[row >= 0]
            if not len(of):
                continue
            hit, first = np.unique(of, return_index=True)  # grams stand in the order of the words
            mean = np.add.reduceat(self.logs[n][row], first, axis=0) / np.diff(np.append(first, len(of)))[:, None]
            out[open_[hit]] = (mean - mean.max(axis=1, keepdims=True)) * (n / LONGEST)
            open_ = np.delete(open_, hit)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return found, scores
        for start, end in steps(texts):
            words = Words(texts[start:end])
            if not len(words.hashes):
                continue
            row = self.find(0, words.hashes)
            adds = self.logs[0][row]
            lacking = np.flatnonzero(row < 0)
            if len(lacking):
                _, first, inverse = np.unique(words.hashes[lacking], return_index=True, return_inverse=True)
                adds[lacking] = self.unseen(words, lacking[first])[inverse]
            of, first = np.unique(words.texts, return_index=True)
            total = np.add.reduceat(adds, first, axis=0, dtype=np.float64)
            p = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(np.diff(np.append(first, len(adds))))[:, None])
            for k, best, score in zip(of.tolist(), total.argmax(axis=1).tolist(), (p.max(axis=1) / p.sum(axis=1)).tolist(), strict=True):
                found[start + k], scores[start + k] = self.langs[best], score
        return found, scores


def predict_with(df: DataFrame, model: dict, keep: list[str], lang_col: str = "lang_pred", score_col: str = "score", text_col: str = "text") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of the fit

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        identifier = Identifier(shared.value)
        for batch in batches:
            out = batch[keep].copy()
            out[lang_col], out[score_col] = identifier.predict([as_text(t) for t in batch["__text"]])
            yield out

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{lang_col}` string, `{score_col}` double"
    return mapped(df.select(*keep, F.col(text_col).alias("__text")), run, schema)


def held_out(id_col: str = "doc_id"):
    return bucket_of(id_col, 4) == 2


def identify(df: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from the rows with a lang that aren't held out. A null id is never held out."""
    labelled = df.filter(F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    model = model or fit(labelled.select("doc_id", "text", "lang"))
    return predict_with(df.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), model, ["doc_id", "held_out"])
