"""From raw documents to token ids: language, near duplicates, personal data, mix of sources, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept, and
returns the columns of documents; the last returns the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuelake.llm import bpe, jaccard, langid, mixing, pii
from cuelake.llm.common import discard, table, written
from cuelake.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows with a lang, rejects documents without a letter, and sets lang to the one found, where there are rows to learn from.

    Null, empty and blank texts have no letter; repeated rows stay or go alike, and ties between languages are broken one way; an empty table stays empty."""
    model = langid.fit(docs.filter("lang IS NOT NULL").select("doc_id", "text", "lang"))
    if not model["langs"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.predict_with(docs, model, docs.columns, "__lang", "__score")
    return found.filter(F.col("__lang") != langid.UNKNOWN).withColumn("lang", F.col("__lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id (null ids last; repeated rows of one id and text all stay or go).

    Texts without words are near to nothing and stay; an empty table stays empty."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds, row by row: repeated rows become the same, null texts stay null, an empty table stays empty."""
    return pii.redact_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a text stands there as often as the mix takes it, its last part by blocks.

    A null source is one of its own, repeated rows count each, texts without words go, an empty table stays empty."""
    return mixing.mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids) of every row of the mix; null counts as the empty text, repeated rows give the same, an empty table gives an empty result."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

#: The language model, the redaction and the tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions, test_language_stage.py the first.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written, and what it has read goes then."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
