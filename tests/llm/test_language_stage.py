"""The language stage rejects only documents without a letter, whatever the model knows of them."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest
import regex

import corpus_pipeline
from cuelake.llm import langid

WORDS = {"de": "und der die das ist nicht", "en": "and the this that is not", "es": "que los las una por con", "fr": "est les des une pas avec"}


def rows(spark, labelled: bool):
    docs = [(k, f"{text} {text}", lang if labelled else None) for k, (lang, text) in enumerate(WORDS.items())]
    docs += [(10, "qqq", None), (11, "xdas", None), (12, "12 + 3", None), (13, None, None), (14, "", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string")


def test_short_documents_stay(spark):
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, rows(spark, True), "").collect()}
    assert set(got) == {0, 1, 2, 3, 10, 11} and got[11] == "de" and None not in got.values()


def test_documents_stay_without_labels(spark):
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, rows(spark, False), "").collect()}
    assert got == dict.fromkeys((0, 1, 2, 3, 10, 11))


def plain_prediction(counts, langs, text):
    """Word-first backoff with dictionaries of strings."""
    kinds = [max((len(counts[la, n]) for la in langs), default=0) for n in range(langid.LONGEST + 1)]
    log = lambda la, n, g: math.log((counts[la, n][g] + 0.5) / (sum(counts[la, n].values()) + 0.5 * kinds[n] + 1))
    words, total = regex.findall(r"\p{L}+", text.lower()), dict.fromkeys(langs, 0.0)
    for w in words:
        if any(w in counts[la, 0] for la in langs):
            for la in langs:
                total[la] += log(la, 0, w)
            continue
        for n in range(langid.LONGEST, 0, -1):
            known = [g for g in grams(w, n) if any(g in counts[la, n] for la in langs)]
            if known:
                mean = {la: sum(log(la, n, g) for g in known) / len(known) for la in langs}
                for la in langs:
                    total[la] += (mean[la] - max(mean.values())) * n / langid.LONGEST
                break
    if not words or not langs:
        return "und", 0.0
    best = max(langs, key=lambda la: total[la])
    return best, 1 / sum(math.exp((total[la] - total[best]) / len(words) ** 0.5) for la in langs)


def grams(word, n):
    own = f"^{word}$" if n > 1 else word
    return [own[k : k + n] for k in range(len(own) - n + 1)]


def test_against_plain_backoff(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    seen = [r for r in docs if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    langs, counts = sorted({r.lang for r in seen}), defaultdict(Counter)
    for r in seen:
        for w, k in Counter(regex.findall(r"\p{L}+", r.text.lower())).items():
            counts[r.lang, 0][w] += k
            for n in range(1, langid.LONGEST + 1):
                for g in grams(w, n):
                    counts[r.lang, n][g] += k
    extra = [(10_000 + k, t, None) for k, t in enumerate(["qqzzyx", "straßenbahnhaltestelle", "ÉTÉ à la", "12", "ǅ", "Ωμέγα", "a", "xq the"])]
    df = spark.createDataFrame([tuple(r) for r in docs] + extra, "doc_id long, text string, lang string").repartition(3)
    text = {i: t for i, t, _ in [*docs, *extra]}
    got = langid.identify(df).collect()
    assert len(got) == len(text)
    for r in got:
        lang, score = plain_prediction(counts, langs, text[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


@pytest.mark.parametrize("langs", [(None, None), ("en", None)])
def test_nothing_to_learn_from(spark, langs):
    """No lang at all, or only in held-out rows (2 is one): every text is und with score 0."""
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 4 == 2)
    df = spark.createDataFrame([(held, "some words of a text", langs[0]), (10_001 if held != 10_001 else 3, "more of it", langs[1])], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(df).collect()} == {("und", 0.0)}
