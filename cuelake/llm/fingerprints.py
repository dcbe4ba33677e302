"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every run of three bytes is hashed to one of 128 buckets. The digest holds, as hex, a length
class (logarithmic), two ratios of the quartiles of the bucket counts, and for each bucket two
bits: the quartile that its count lies in. Two digests are compared by a score that adds the
bucket distances, the length distance and the ratio distances; it is bounded, and the
likeness is 1 for equal digests and 0 from the bound on.

Texts under three bytes have no triplets: all their buckets are 0 and only the length class
tells them apart. Null counts as the empty text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import as_text, mapped, written

BUCKETS = 128
LENGTH_BASE = 1.2
#: Distance of two quartile codes: opposite ends count double.
CODE_DISTANCE = np.array([0, 1, 2, 6])
SCORE_BOUND = 300


def digest(data: bytes) -> tuple[np.ndarray, str]:
    """(length class, two ratios, then the bucket codes; the same as hex)."""
    if len(data) >= 3:
        b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
        h = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
        counts = np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, dtype=np.int64)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    head = [min(255, round(math.log(len(data) + 1, LENGTH_BASE))), int(q1 * 15 // max(q3, 1)), int(q2 * 15 // max(q3, 1))]
    packed = (codes[0::4] << 6) | (codes[1::4] << 4) | (codes[2::4] << 2) | codes[3::4]
    return np.concatenate([np.array(head, dtype=np.uint8), codes]), bytes([head[0], head[1] << 4 | head[2]]).hex() + packed.tobytes().hex()


def difference(a: np.ndarray, b: np.ndarray) -> int:
    d = np.abs(a.astype(np.int64) - b.astype(np.int64))
    return int(CODE_DISTANCE[d[3:]].sum() + 3 * d[0] + d[1] + d[2])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - min(difference(a, b), SCORE_BOUND) / SCORE_BOUND


def parse(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    codes = np.stack([raw[2:] >> 6, (raw[2:] >> 4) & 3, (raw[2:] >> 2) & 3, raw[2:] & 3], axis=1).ravel()
    return np.concatenate([[raw[0], raw[1] >> 4, raw[1] & 15], codes]).astype(np.uint8)


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by the beginning of another."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def compared(text: str, following: str, own: tuple | None = None) -> tuple:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), and the digest of the following text."""
    a, a_hex = own or digest(text.encode("utf-8", "surrogatepass"))
    edited = edit(text, following).encode("utf-8", "surrogatepass")
    e, e_hex = digest(edited)
    after = digest(following.encode("utf-8", "surrogatepass"))
    return (len(text), hashlib.sha256(edited).hexdigest(), a_hex, e_hex, likeness(a, e), likeness(a, after[0])), after


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digests of its text and of its edited text, likeness to both its edited text and the next row.

    The next row is the one that follows in descending order of id (null ids last, equal ids by a
    hash of the text), and the first after the last; a table of one row follows itself. Rows are
    dealt by ranges of the id, so every partition finds the next rows by itself but for its last one;
    those, two a partition, are joined afterwards.
    """
    kind = dict(df.dtypes)[id_col]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    order = [F.col("id").desc_nulls_last(), F.col("tie")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, own, seen = TaskContext.get().partitionId(), None, None, False
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], map(as_text, batch["text"]), strict=True):
                if not seen:
                    rows.append((key, part, "first", text, *[None] * 6))
                    seen = True
                else:
                    got, own = compared(held[1], text, own)
                    rows.append((held[0], part, "row", None, *got))
                held = (key, text)
            if rows:
                yield pd.DataFrame(rows, columns=["id", "part", "kind", "text", *NAMES]).astype({"n_chars": "Int64"})
        if held:
            yield pd.DataFrame([(held[0], part, "last", held[1], *[None] * 6)], columns=["id", "part", "kind", "text", *NAMES]).astype({"n_chars": "Int64"})

    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    staged = written(mapped(dealt, run, f"id {kind}, part int, kind string, text string, {FIELDS}"), "fingerprints")
    first = staged.filter("kind = 'first'").select("part", F.col("text").alias("following"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = first.select(F.col("part").alias("before"), F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(every)).alias("part"))  # a number for each partition
    ends = staged.filter("kind = 'last'").select("id", F.col("part").alias("before"), "text").join(follows, "before").join(first, "part")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *compared(as_text(text), as_text(following))[0]) for key, text, following in zip(batch["id"], batch["text"], batch["following"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", *NAMES])

    last = mapped(ends.select("id", "text", "following"), finish, f"id {kind}, {FIELDS}")
    return staged.filter("kind = 'row'").select("id", *NAMES).unionByName(last).withColumnRenamed("id", id_col)
