"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import pytest

from cuelake.llm import bpe, fingerprints, html_text, jaccard, langid, media, mixing, pii, quality, repeats
from cuelake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, start int, taken string, packed string, th string, cls string, n int, label string, score string, held_out string, batch int"
LONG = "word after word goes on and on without end " * 9000
BASE = [
    (1, "A plain text with enough words to make a few shingles of it.", "en", "a"),
    (1, "A plain text with enough words to make a few shingles of it.", "en", "a"),
    (1, "The same id, but quite another text it is, and that is fine too.", "en", "b"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \n\t ", "de", "b"),
    (5, "short", "fr", None),
    (None, "Kein Name, aber ein Text mit genug Worten für alles, was folgt.", "de", "b"),
    (6, LONG, "en", "c"),
    (7, "x" * 50_000, "en", "c"),
    (8, "\U0001f600\x00 é ß €", None, "c"),
    (9, "1 2 3 +++ --- 192.168.0.1 a@b.co", "en", "c"),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, la, s, None if t is None else len(t), *["x", 1, "y", "z", "t", "c", 2, "l", "s", "h", 3]) for i, t, la, s in BASE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, None), (7, None, 0), (None, 1, 1), (9, 1, 0)], LABELS)
    return {
        "repeats": repeats.remove_repeats,
        "quality": lambda d: quality.score_documents(d, labels),
        "pii": pii.find_pii,
        "redact": pii.redact_pii,
        "mixing": mixing.mix_sources,
        "mixed": mixing.mixed_texts,
        "jaccard": jaccard.jaccard_components,
        "keep_one": jaccard.keep_one,
        "media": media.media_digests,
        "clips": lambda d: media.clip_rows(media.store_media(d)),
        "bpe": lambda d: bpe.encode_documents(d, tokenizer_path()),
        "decoded": lambda d: bpe.decode_documents(bpe.encode_documents(d, tokenizer_path()), tokenizer_path()),
        "langid": langid.identify,
        "fingerprints": fingerprints.fingerprint_documents,
    }


SAME_COUNT = {"repeats", "quality", "pii", "redact", "mixing", "jaccard", "media", "bpe", "decoded", "langid", "fingerprints"}


@pytest.mark.parametrize("name", ["bpe", "clips", "decoded", "fingerprints", "jaccard", "keep_one", "langid", "media", "mixed", "mixing", "pii", "quality", "redact", "repeats"])
def test_operator(spark, docs, nothing, name):
    op = operators(spark)[name]
    got = op(docs).collect()
    if name in SAME_COUNT:
        assert len(got) == len(BASE)
    if name in ("redact", "mixed", "keep_one"):
        assert op(docs).columns == docs.columns
    assert op(nothing).collect() == []
    assert op(docs.select("doc_id", "text", "lang", "source")).count() == len(got)


def test_equal_texts_have_equal_results(spark, docs):
    same = media.media_digests(docs).filter("doc_id = 1").collect()
    assert len({r.media_sha256 for r in same}) == 2 and len(same) == 3
    own = fingerprints.fingerprint_documents(docs).filter("doc_id = 1").collect()
    assert len({r.fingerprint for r in own}) == 2


def test_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p>One, two.</p>", 3), (3, "u", "<<<p><a href='x>&nbsp;&amp;", 4), (4, "u", "<b>" * 20_000 + "deep, text.", 5), (4, "u", "plain text", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r.page_id, r.text) for r in html_text.extract_pages(df).collect()}
    assert {(1, ""), (2, ""), (None, "One, two."), (4, "plain text"), (4, "deep, text.")} <= got
    assert html_text.extract_pages(df.limit(0)).collect() == []


def test_pipeline_stages(spark, docs, nothing):
    pipeline = pytest.importorskip("corpus_pipeline")
    for start in (docs, nothing):
        d = start
        for _, stage in pipeline.STAGES[:-1]:
            d = stage(spark, d, "")
            assert d.columns == docs.columns
            d = spark.createDataFrame(d.collect(), d.schema)
        pipeline.STAGES[-1][1](spark, d, "").collect()
