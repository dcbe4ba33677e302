"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's words are cut into blocks of equal size. Blocks are allotted to sources by the
highest quotients target / (2 q + 1); a source's blocks are allotted to its shards in the same
way. A shard with quota q of n blocks gives all of them q div n times and q mod n of them once
more, picked by a seeded one-to-one map of the block numbers.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import as_text, mapped, written

BLOCK_WORDS = 32
DOCS_PER_SHARD = 8192
MAX_REPEATS = 3
BUCKETS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: list[str | None]) -> dict[str | None, int]:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: 1 + k % 3 for k, s in enumerate(ordered)}


def targets(sizes: dict, weights: dict, repeats: int = MAX_REPEATS) -> dict:
    """Shares of all words by weight; what a source can't fill goes to the others until none is above its limit."""
    total, out, open_ = float(sum(sizes.values())), {}, list(sizes)
    while open_:
        left = total - sum(out.values())
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        over = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not over:
            return out | share
        out |= {s: float(repeats * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in out]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 q + 1), none beyond its limit; ties go to the first.

    Rounding votes by one common divisor gives the allotment of some smaller number of seats, from
    which only a few highest quotients are left to hand out one by one.
    """
    total, n = sum(votes), len(votes)
    seats = min(seats, sum(most))
    if total <= 0 or seats <= 0:
        return [0] * n
    base = max(0.0, seats - n / 2)
    got = [min(m, max(0, math.floor(v * base / total + 0.5 - 1e-9))) for v, m in zip(votes, most, strict=True)]
    left = seats - sum(got)
    heap = [(-v / (2 * q + 1), i) for i, (v, q, m) in enumerate(zip(votes, got, most, strict=True)) if q < m]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def permutation(n: int, seed: str) -> tuple[int, int]:
    """(a, c) of the one-to-one map b -> (a b + c) mod n; a near the golden section spreads the picks evenly."""
    a = max(1, round(n * 0.6180339887498949))
    while math.gcd(a, n) != 1:
        a += 1
    return a, int.from_bytes(hashlib.sha256(seed.encode()).digest()[:6], "big") % max(n, 1)


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, size, source_size, target, taken) of every row.

    A null text has size 0 and is never taken; null is a source of its own. Repeated rows count
    each; an empty table gives an empty result. The totals of the sources come to the driver: one row for each source that the mix
    weighs. Texts are read once and never shuffled.
    """
    plan = block_plan(df, id_col, text_col, source_col, keep=False, **options)
    return plan.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", "taken")


def block_plan(df: DataFrame, id_col: str, text_col: str, source_col: str, keep: bool, seed: int = 7, block_words: int = BLOCK_WORDS, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """What mix_sources returns, the place of each row in its shard and the shard's blocks; with `keep` also the row itself, as a struct."""
    size = n_words(text_col)
    tie = F.xxhash64(F.col(text_col))  # rows that share an id, as all without one do, are still dealt over the buckets, and in one order
    bucket = F.pmod(F.xxhash64(F.col(id_col).cast("string"), tie, F.lit(seed)), F.lit(BUCKETS))
    base = df.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), size.alias("__size"), bucket.alias("__bucket"), tie.alias("__tie"), *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")] if keep else []))
    base = base if keep else written(base, "mix-sizes")  # words are counted once, but where rows would be stored for that
    stats = written(base.groupBy("__source", "__bucket").agg(F.sum("__size").alias("words"), F.count("*").alias("docs")), "mix-stats")
    totals = stats.groupBy("__source").agg(F.sum("words").alias("words"), F.sum("docs").alias("docs")).collect()
    sizes = {r["__source"]: r["words"] for r in sorted(totals, key=lambda r: (r["__source"] is None, r["__source"] or ""))}  # in one order, so that sums agree to the last bit
    names = list(sizes)
    want = targets(sizes, cyclic_weights(names))
    limits = [MAX_REPEATS * math.ceil(sizes[s] / block_words) for s in names]
    quota = dict(zip(names, sainte_lague([want[s] for s in names], round(sum(want.values()) / block_words), limits), strict=True))
    shards = {r["__source"]: min(BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, r["docs"] / docs_per_shard))))) for r in totals}
    plan = df.sparkSession.createDataFrame([(s, sizes[s], want[s], quota[s], shards[s]) for s in names] or [(None, 0, 0.0, 0, 1)], "source string, source_size long, target double, quota long, shards int")
    plan = written(plan, "mix-plan")  # so that Spark knows its size: rows needn't be dealt by source to meet it

    def allot(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard", ignore_index=True)
        blocks = [math.ceil(w / block_words) for w in group["words"]]
        got = sainte_lague([float(w) for w in group["words"]], int(group["quota"].iloc[0]), [MAX_REPEATS * b for b in blocks])
        maps = [permutation(max(b, 1), f"{seed}:{s}:{k}") for b, s, k in zip(blocks, group["source"], group["shard"], strict=True)]
        return pd.DataFrame({
            "source": group["source"], "source_size": group["source_size"], "target": group["target"], "shards": group["shards"], "shard": group["shard"], "n": [max(b, 1) for b in blocks],
            "whole": [q // max(b, 1) for q, b in zip(got, blocks, strict=True)], "more": [q % max(b, 1) for q, b in zip(got, blocks, strict=True)], "a": [m[0] for m in maps], "c": [m[1] for m in maps],
        })

    same = F.col("__source").eqNullSafe(F.col("source"))
    by_shard = stats.join(plan, same).withColumn("shard", F.col("__bucket") % F.col("shards")).groupBy("source", "source_size", "target", "quota", "shards", "shard").agg(F.sum("words").alias("words"))
    schema = "source string, source_size long, target double, shards int, shard long, n long, whole long, more long, a long, c long"
    dealt = written(by_shard.groupBy("source").applyInPandas(allot, schema), "mix-shards")  # its size is known before the rows move: they move once
    rows = base.join(plan.select(F.col("source").alias("__s"), F.col("shards").alias("__n")), F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__shard", F.col("__bucket") % F.col("__n"))
    inside = Window.partitionBy("__source", "__shard").orderBy(F.xxhash64(F.lit(seed), "__id"), "__id", "__tie")
    rows = rows.withColumn("start", F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__size"))
    joined = rows.join(dealt, same & (F.col("__shard") == F.col("shard")))
    once = F.expr(f"""aggregate(sequence(start div {block_words}, (start + __size - 1) div {block_words}), 0L,
        (t, b) -> t + IF(pmod(b * a + c, n) < more, least((b + 1) * {block_words}, start + __size) - greatest(b * {block_words}, start), 0L))""")
    taken = F.when(F.col("__size") > 0, F.col("whole") * F.col("__size") + once).otherwise(F.lit(0)).cast("long")
    return joined.select("__id", "__size", "source_size", "target", taken.alias("taken"), *(["__row"] if keep else []), "start", "n", "whole", "more", "a", "c")


def mixed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mix as rows with the columns of df: a whole text for every full repeat, then one row with the blocks taken once more.

    Texts without words are not part of any block and go. A run of taken blocks keeps its inner
    white space; runs are joined by a newline. A column n_chars follows the text.
    """
    columns = df.columns
    mixed = block_plan(df, id_col, text_col, source_col, keep=True, block_words=block_words, **options).filter("taken > 0")
    packed = mixed.select("__row.*", F.struct(F.col("__size").alias("size"), "taken", "start", "n", "whole", "more", "a", "c").alias("__plan"))
    word = re.compile(WORD)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, texts = [], []
            for k, (text, p) in enumerate(zip(map(as_text, batch[text_col]), batch["__plan"], strict=True)):
                at += [k] * p["whole"]
                texts += [text] * p["whole"]
                if p["taken"] > p["whole"] * p["size"]:
                    spans, runs = [m.span() for m in word.finditer(text)], []
                    first, end = p["start"], p["start"] + p["size"]
                    for b in range(first // block_words, (end - 1) // block_words + 1):
                        if (b * p["a"] + p["c"]) % p["n"] < p["more"]:
                            lo, hi = max(b * block_words, first) - first, min((b + 1) * block_words, end) - first
                            if runs and runs[-1][1] == lo:
                                runs[-1][1] = hi
                            else:
                                runs.append([lo, hi])
                    at.append(k)
                    texts.append("\n".join(text[spans[lo][0] : spans[hi - 1][1]] for lo, hi in runs))
            out = batch.drop(columns="__plan").iloc[at].reset_index(drop=True)
            out[text_col] = texts
            if "n_chars" in columns:
                out["n_chars"] = [len(t) for t in texts]
            yield out[columns]

    return mapped(packed, run, df.schema)
