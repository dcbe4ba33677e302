"""Removal of word passages that an earlier document has: winnowed seeds, extended to maximal repeats.

A window is WINDOW consecutive words of a document. A word goes if a window that covers it also starts in a
document with a smaller id. Every window picks a seed, the place of the least hash of its SEED-word
grams (leftmost on ties), so equal windows have seeds at the same offset; a seed has a context, all words
of the windows that picked it.

- Seeds are joined on their grams; those whose gram comes once go. Seeds with one gram and one context are a
  class, which the smallest id that has it stands for: all others lose their windows to it.
- Classes that share a gram are extended against the gram's leader, the class with the smallest id: the words that
  agree to the left and to the right of the seed are a maximal match, and its windows are decided,
  for the class and for every class with the same windows.
- Windows that aren't the leader's can only equal one another. Blocks of BLOCK adjoining windows have words in common, a longer
  seed; blocks that share it with no other class go, and of the others each window is a seed of its
  own, which goes to the smallest id. No pairs within a gram are listed: rows stay a multiple of the seeds.

All ranges of a document together are its maximal repeats. Rows are told apart by id and a hash of the text, so
that ids may repeat; a null id is larger than all others, and null ids are no smaller than one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_mapped, as_bytes, discard, mapped, mix64, pack_text, powers, unpack_text, word_hashes, written
from .repeats import common_prefix, merge_spans

WINDOW = 50
SEED = 16
#: Adjoining windows that share a longer seed.
BLOCK = 8
#: A seed's place: position in the document, then the words of its context before it and from it on.
POSITION_BITS, COUNT_BITS = 40, 8
_FACTOR = 0x9E3779B97F4A7C15


def seeds(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(place, first word and end of the context, gram) of the seeds of all windows over the words of several documents; owner says whose each word is."""
    n = len(hashes)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64)
    h, size, factor = hashes, 1, _FACTOR
    while size < seed:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    h = mix64(h)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, size = window - seed + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: size - span], low[span - size :])
    begin = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])  # windows inside one document
    if not len(begin):
        return none, none, none, none.view(np.uint64)
    at = (low[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[True], at[1:] != at[:-1]])
    last = np.concatenate([first[1:], [True]])
    return at[first], begin[first], begin[last] + window, h[at[first]]


def find_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, place, gram, ctx) of documents (doc_id, th, text); ctx is a hash of the context and of the seed's offset in it."""
    for batch in batches:
        raw = [as_bytes(t) for t in batch.column("text").to_pylist()]
        data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
        starts, _, hashes = word_hashes(data)
        owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
        at, low, high, gram = seeds(hashes, owner)
        if not len(at):
            continue
        up, down = powers(len(hashes) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), (hashes * up[: len(hashes)]).cumsum(dtype=np.uint64)])
        before, after = at - low, high - at
        ctx = mix64((sums[high] - sums[low]) * down[low] + (before * 64 + after).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        doc = owner[at]
        position = at - np.searchsorted(owner, doc)
        place = position | before << POSITION_BITS | after << (POSITION_BITS + COUNT_BITS)
        row = pa.array(doc)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(place), pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64))], ["doc_id", "th", "place", "gram", "ctx"])


def parts(place: str = "place") -> tuple[Column, Column, Column]:
    """(position, words before, words from there) of a place."""
    p = F.col(place)
    bits = lambda shift, n: F.shiftright(p, shift).bitwiseAND((1 << n) - 1)
    return bits(0, POSITION_BITS), bits(POSITION_BITS, COUNT_BITS), bits(POSITION_BITS + COUNT_BITS, COUNT_BITS)


def earlier(a: str, b: str) -> Column:
    """Whether id a is smaller than id b; nulls are larger than all others."""
    return F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) < F.col(b)))


CUT = "gram long, ctx long, before int, text binary"


def cut_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of each wanted context, joined by blanks."""
    names = [c.split()[0] for c in CUT.split(", ")]
    for batch in batches:
        rows = []
        for text, wanted in zip(batch["packed"], batch["wanted"], strict=True):
            words = unpack_text(text).split()
            for w in wanted:
                rows.append((w["gram"], w["ctx"], w["before"], b" ".join(words[w["pos"] - w["before"] : w["pos"] + w["after"]])))
                if len(rows) == 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)


def word_starts(text: bytes) -> np.ndarray:
    """The first byte of each word of a text joined by blanks, and one past its last blank."""
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32) + 1, [len(text) + 1]])


def words_shared(a: bytes, b: bytes) -> int:
    """How many whole words two texts have in common from the beginning."""
    if not a or not b:
        return 0
    p = common_prefix(a, b)
    whole = (p == len(a) or a[p] == 32) and (p == len(b) or b[p] == 32)
    return a.count(b" ", 0, p) + whole


def extend(text: bytes, before: int, other: bytes, other_before: int) -> tuple[int, int]:
    """How many words two contexts share to the left of the seed and from the seed on."""
    a, b = int(word_starts(text)[before]), int(word_starts(other)[other_before])
    return words_shared(text[: max(a - 1, 0)][::-1], other[: max(b - 1, 0)][::-1]), words_shared(text[a:], other[b:])


#: Offsets of windows that are the leader's, or the windows of a block that aren't (hashes: one for each from low on).
DECIDED = "gram long, ctx long, low int, high int, block long, hashes array<long>"


def against_leader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a class with its leader: the windows that the two share, and the blocks of the windows that they don't.

    A window is told by its offset, the words from its beginning to the seed. A block's hash is that of the words that all windows with these offsets have."""
    names = [c.split()[0] for c in DECIDED.split(", ")]
    for batch in batches:
        rows = []
        for gram, ctx, before, text, other_before, other in zip(*(batch[c] for c in ("gram", "ctx", "before", "text", "other_before", "other")), strict=True):
            left, right = extend(text, before, other, other_before)
            at = word_starts(text)
            least, most = WINDOW - (len(at) - 1 - before), before
            low, high = max(least, WINDOW - right), min(most, left)
            if low <= high:
                rows.append((gram, ctx, low, high, None, None))
                rest = [(least, low - 1), (high + 1, most)]
            else:
                rest = [(least, most)]
            part = lambda o, end: text[at[before - o] : at[before + end] - 1]  # noqa: E731, B023
            for first, last in rest:
                while first <= last:
                    base = first // BLOCK * BLOCK
                    end = min(last, base + BLOCK - 1)
                    block = xxhash.xxh3_64_intdigest(part(base, WINDOW - base - BLOCK + 1), base) - (1 << 63)
                    rows.append((gram, ctx, first, end, block, [xxhash.xxh3_64_intdigest(part(o, WINDOW - o), o) - (1 << 63) for o in range(first, end + 1)]))
                    first = end + 1
            if len(rows) >= 5000:
                yield pd.DataFrame(rows, columns=names).astype({"block": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"block": "Int64"})


def lost_windows(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(gram, ctx, ranges): for classes (gram, ctx, first_id, th, place) the offsets of windows that a class with a smaller first_id has too."""
    shared = written(classes.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram"), "seeds-shared")  # counts are written before they are joined: Spark splits a hot gram only where nothing in its stage needs it whole
    rivals = written(classes.join(shared, "gram"), "seeds-rivals")
    discard(shared)
    position, before, after = parts()
    wanted = rivals.select("first_id", "th", F.struct(position.alias("pos"), before.cast("int").alias("before"), after.cast("int").alias("after"), "gram", "ctx").alias("w"))
    wanted = wanted.groupBy("first_id", "th").agg(F.collect_list("w").alias("wanted")).withColumnRenamed("th", "own_th")  # no more than the seeds of one document
    texts = packed_texts(docs)
    rows = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("first_id")) & (texts["th"] == F.col("own_th"))).select("packed", "wanted")
    contexts = mapped(rows, cut_contexts, CUT).dropDuplicates(["gram", "ctx"])  # rows may agree in id and text
    whole = written(contexts.join(rivals.select("gram", "ctx", "first_id"), ["gram", "ctx"]), "seeds-contexts")

    leaders = rivals.groupBy("gram").agg(F.coalesce(F.min_by("ctx", "first_id"), F.first("ctx")).alias("leading"), F.min("first_id").alias("leader_id"))
    leaders = written(leaders.join(whole.select("gram", F.col("ctx").alias("leading"), F.col("before").alias("other_before"), F.col("text").alias("other")), ["gram", "leading"]), "seeds-leaders")
    discard(rivals)
    met = whole.join(leaders, "gram").filter("ctx <> leading").select("gram", "ctx", "before", "text", "other_before", "other")
    decided = written(mapped(met, against_leader, DECIDED), "seeds-decided")
    ids = whole.select("gram", "ctx", "first_id")
    own = decided.filter("block IS NULL").join(ids, ["gram", "ctx"]).join(leaders.select("gram", "leader_id"), "gram").filter(earlier("leader_id", "first_id")).select("gram", "ctx", "low", "high")

    blocks = decided.filter("block IS NOT NULL")
    again = written(blocks.groupBy("gram", "block").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "block"), "seeds-blocks")
    singles = blocks.join(again, ["gram", "block"]).join(ids, ["gram", "ctx"]).select("gram", "ctx", "first_id", "low", F.posexplode("hashes").alias("k", "window"))
    singles = written(singles.select("gram", "ctx", "first_id", (F.col("low") + F.col("k")).alias("low"), "window"), "seeds-windows")
    firsts = written(singles.groupBy("gram", "window", "low").agg(F.min("first_id").alias("least_id"), F.count("*").alias("n")).filter("n > 1"), "seeds-firsts")
    later = singles.join(firsts, ["gram", "window", "low"]).filter(earlier("least_id", "first_id")).select("gram", "ctx", "low", F.col("low").alias("high"))
    out = written(own.unionByName(later).groupBy("gram", "ctx").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "seeds-ranges")  # no more than the windows of a seed
    discard(whole, leaders, decided, again, singles, firsts)
    return out


def packed_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, th, text) with the texts packed for the shuffle; ids keep their type and their nulls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([pack_text(t) for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "th", "packed"])

    return arrow_mapped(docs.select("doc_id", "th", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, th long, packed binary")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans): the ranges of words of documents (doc_id, th, text) that windows of earlier documents cover."""
    kind = dict(docs.dtypes)["doc_id"]
    found = written(arrow_mapped(docs, find_seeds, f"doc_id {kind}, th long, place long, gram long, ctx long"), "seeds-found")
    again = written(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "seeds-again")
    twice = written(found.join(again, "gram"), "seeds-twice")
    discard(found, again)
    first = lambda c: F.coalesce(F.min_by(c, "doc_id"), F.first(c)).alias(c)  # noqa: E731  both of one row
    classes = written(twice.groupBy("gram", "ctx").agg(F.min("doc_id").alias("first_id"), first("th"), first("place"), F.count("*").alias("n")), "seeds-classes")
    ranges = lost_windows(classes.drop("n"), docs)
    reach = written(classes.select("gram", "ctx", "first_id", "n").join(ranges, ["gram", "ctx"], "left").filter("n > 1 OR ranges IS NOT NULL").drop("n"), "seeds-reach")
    position, before, after = parts()
    span = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    spans = F.when(earlier("first_id", "doc_id"), F.array(span(position - before, position + after))).otherwise(F.transform("ranges", lambda r: span(position - r["high"], position - r["low"] + WINDOW)))
    each = twice.join(reach, ["gram", "ctx"]).select("doc_id", "th", F.explode(spans).alias("span"))
    out = written(each.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans")), "seeds-spans")  # within one document
    discard(twice, classes, ranges, reach)
    return out


def remove_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept binary]) of every row: the words that stay, joined by one space.

    Null and empty texts have no words; texts shorter than a window lose nothing; rows with one id lose nothing to one another, so
    repeated rows all stay or go alike; an empty table gives an empty result, and only the two columns named are read. Texts are read in
    two passes and shuffled twice, once to cut contexts and once to remove the ranges.
    """
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).cast("long").alias("th"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_ranges(docs).select(F.col("doc_id").alias("own"), F.col("th").alias("own_th"), "spans")
    whole = packed_texts(docs)
    rows = whole.join(spans, whole["doc_id"].eqNullSafe(F.col("own")) & (whole["th"] == F.col("own_th")), "left").select("doc_id", "packed", "spans")
    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())][: 4 if texts else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for text, ranges in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = unpack_text(text).split()
                n = len(words)
                for low, high in reversed(merge_spans((r["low"], r["high"]) for r in ranges or [])):
                    del words[low:high]
                kept = b" ".join(words)
                for column, x in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True))], [id_col, *(f for f, _ in fields)])

    return arrow_mapped(rows, run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept binary" if texts else ""))
