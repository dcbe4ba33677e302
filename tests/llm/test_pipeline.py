"""The stages of the pipeline against plain versions, each on its own input."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from test_brute_force import plain_components, plain_pii

import corpus_pipeline
from cuelake.llm import mixing, pii
from cuelake.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_near_duplicates(spark, docs):
    rows = docs.collect()
    plain = plain_components([(r.doc_id, r.text) for r in rows])
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(map(tuple, kept)) == sorted(tuple(r) for r in rows if plain[r.doc_id][1] == r.doc_id)


def test_personal_data(spark, docs):
    """Where a text holds base kinds only, each stretch of overlapping spans becomes the name of its first kind."""
    finder, texts, some = pii.Finder(), {r.doc_id: r for r in docs.collect()}, 0
    for r in corpus_pipeline.personal_data(spark, docs, SF).collect():
        before = texts[r.doc_id]
        assert (r.lang, r.source, r.n_chars) == (before.lang, before.source, len(r.text))
        if any(kind >= pii.BASE for _, kind, _ in finder.spans(before.text)):
            continue
        out, at, until = "", 0, 0
        for start, kind, end in plain_pii(before.text):
            if start >= until:
                out += before.text[at:start] + f"<{pii.KINDS[kind].upper()}>"
                some += 1
            at = until = max(until, end)
        assert r.text == out + before.text[at:]
    assert some


def test_mix_and_tokens(spark, docs):
    """A text stands there whole as often as the plan says, its rest is made of runs of its words; the tokens are the library's."""
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_sources(docs).collect()}
    mixed = corpus_pipeline.mix(spark, docs, SF)
    found = defaultdict(list)
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        found[r.doc_id].append(r.text)
    for i, (size, words) in taken.items():
        whole = [t for t in found[i] if t == texts[i]]
        rest = [t for t in found[i] if t != texts[i]]
        assert len(whole) == words // max(size, 1) and len(rest) == (words % max(size, 1) > 0)
        for t in rest:
            assert len(re.findall(mixing.WORD, t)) == words % size
            assert not Counter(re.findall(mixing.WORD, t)) - Counter(re.findall(mixing.WORD, texts[i]))
    own = sorted((r.doc_id, tuple(r.token_ids), r.ids_sha256) for r in corpus_pipeline.tokens(spark, mixed, SF).collect())
    ids = [(i, tokenizer.encode(t, add_special_tokens=False).ids) for i, ts in found.items() for t in ts]
    assert own == sorted((i, tuple(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids)


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, got.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))
