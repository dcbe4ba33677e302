"""Spelling variants grouped by PartEnum signatures.

The words are those of the whole corpus, counted once. Two words are near if one code point inserted,
deleted or replaced makes one the other. Their letter multisets, read as binary vectors with a dimension
for each letter and occurrence, then differ in two dimensions (a letter replaced) or in one (a letter
more), so near words are found without comparing all of them:

- The dimensions are dealt into parts, frequent letters in turn. Of four parts a replaced letter leaves
  two untouched, of three parts a further letter leaves two: each choice of two parts, the vector there and
  the length make a signature that near words share.
- One edit also leaves one half of a word alone, so a signature is taken with the first half and with the second
  half; words with common letters but another order don't meet.
- Signatures are joined by equality, and the join keeps the pairs whose edit distance is one. It emits near pairs
  only, never the pairs of a group.

Words with a signature in common are different words, so no signature is as frequent as a frequent word.
The form of a word is its most frequent near word, where that is FORM_TIMES as frequent at least; forms are followed to
the last by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import discard, mapped, mix64, powers, written

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT = 6, 5
FORM_TIMES = 5
#: A run loses a letter where its hash is a multiple of this.
DROPPED_EACH = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters by how frequent they usually are, so that parts get like shares of a word.
FREQUENT_FIRST = "etaoinshrdlucmfwypvbgkjqxz"
PARTS_REPLACED, PARTS_LONGER = 4, 3
#: What a signature stands for: words of one length, the shorter or the longer of two.
SAME, SHORTER, LONGER = 0, 1, 2
SIGNATURES = "sig long, role int, word string, n long"
_RANK = np.arange(256, dtype=np.int64)
_RANK[[ord(c) for c in FREQUENT_FIRST]] = np.arange(len(FREQUENT_FIRST))


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of LEAST_LETTERS letters and LEAST_COUNT occurrences at least. A run loses a letter where its hash with the id says so; a null id counts as the empty text in it."""
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))  # whole runs: shorter ones can't become words
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DROPPED_EACH == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.select("run", h.alias("h")).select(word.alias("word")).filter(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def part_sums(letters: np.ndarray, owner: np.ndarray, n: int, parts: int) -> np.ndarray:
    """For each of n words and each part a hash of the word's vector there: the sum of a hash for each of its dimensions."""
    order = np.lexsort((letters, owner))
    letter, word = letters[order].astype(np.int64), owner[order]
    first = np.concatenate([[True], (letter[1:] != letter[:-1]) | (word[1:] != word[:-1])])
    begin = np.flatnonzero(first)
    nth = np.arange(len(letter)) - np.repeat(begin, np.diff(np.append(begin, len(letter))))
    part = (_RANK[letter] + 7 * nth) % parts
    out = np.zeros(n * parts, dtype=np.uint64)
    np.add.at(out, word * parts + part, mix64((letter.astype(np.uint64) << np.uint64(32)) + nth.astype(np.uint64) + np.uint64(1)))
    return out.reshape(n, parts)


def signatures(words: list[str]) -> list[tuple[int, np.ndarray]]:
    """(role, a signature for each word), for all roles, choices of parts and halves."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    end = np.cumsum(size)
    begin, owner = end - size, np.repeat(np.arange(len(words)), size)
    up, down = powers(len(letters) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), ((letters.astype(np.uint64) + np.uint64(1)) * up[: len(letters)]).cumsum(dtype=np.uint64)])
    span = lambda low, high: mix64((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))
    out = []
    for role, parts, length in ((SAME, PARTS_REPLACED, size), (SHORTER, PARTS_LONGER, size), (LONGER, PARTS_LONGER, size - 1)):
        own, half = part_sums(letters, owner, len(words), parts), length // 2
        kind = np.uint64(1 + (role != SAME))
        for half_no, shared in ((1, span(begin, begin + half)), (2, span(end - (length - half), end))):
            for a, b in combinations(range(parts), 2):
                tag = (kind << np.uint64(16)) + np.uint64(half_no << 8 | a << 4 | b)
                out.append((role, mix64(mix64(mix64(own[:, a] + tag) + own[:, b]) + shared + (length.astype(np.uint64) << np.uint64(32))).view(np.int64)))
    return out


def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = batch["word"].tolist()
        for role, sig in signatures(words) if words else ():
            yield pd.DataFrame({"sig": sig, "role": np.int32(role), "word": batch["word"], "n": batch["n"]})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of near words, in both directions, of (word, n)."""
    signed = written(mapped(words, sign, SIGNATURES), "spelling-signatures")
    a = signed.filter(F.col("role") != LONGER).select("sig", "role", F.col("word").alias("word"), F.col("n").alias("n"))
    b = signed.filter(F.col("role") != SHORTER).select("sig", F.col("word").alias("other"), F.col("n").alias("other_n"))
    once = (F.col("role") == SHORTER) | (F.col("word") < F.col("other"))
    met = a.join(b, "sig").filter(once & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")
    pairs = written(met.distinct(), "spelling-pairs")
    discard(signed)
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last. Each round doubles how far a pointer reaches; a form is FORM_TIMES as frequent as its word, so chains end soon."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = step
        if step.filter("moved").isEmpty():
            return step.select("word", "root")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the corpus with its form, if any, and the last form that it leads to.

    Null texts have no words, repeated rows count each, ties between forms go to the first in code-point order, an empty table
    gives an empty result, and only the two columns named are read. Texts are read once and never shuffled: words are
    counted before they move. Words may have any length.
    """
    words = written(word_counts(df, id_col, text_col), "spelling-words")
    near = near_words(words)
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    chosen = near.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("own"), best.alias("best"))
    holds = -F.col("best.n") >= FORM_TIMES * F.col("own")
    chosen = written(chosen.select("word", "n_near", F.when(holds, F.col("best.word")).alias("form"), F.when(holds, -F.col("best.n")).alias("form_n")), "spelling-chosen")
    roots = last_forms(chosen.filter("form IS NOT NULL"))
    out = words.join(chosen, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
