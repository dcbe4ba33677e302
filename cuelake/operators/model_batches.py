"""UDF-1. The one place where a user's function runs: texts in, texts out, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import clean_text
from .windows import numbered

Model = Callable[[list[str]], list[str]]


def answers(ask: Model, texts: list[str]) -> list[str]:
    """One answer for each text; a batch that returns another number of lines than it got is asked again text by text."""
    if not texts:
        return []
    got = list(ask(texts))
    return got if len(got) == len(texts) else [" ".join(ask([t])) for t in texts]


def in_order(df: DataFrame, make: Callable[[], Model], track: str, order: list[str], text_col: str = "text", out_col: str = "translated_text", batch: int = 8) -> DataFrame:
    """df with out_col: the function sees the rows of each track in order, `batch` adjoining rows at once.

    Blank and null texts count as rows of their batch, but never reach the function, and give ''. Batches are numbered first and dealt by
    track and number, so a long track spreads over tasks; a task holds one batch at a time. Rows that agree in
    track and order come in any order.
    """
    columns = df.columns
    dealt = numbered(df, track, order, batch, "__batch", "__place").withColumn("__said", F.length(clean_text(F.col(text_col))) > 0)
    dealt = dealt.repartition(track, "__batch").sortWithinPartitions(track, "__batch", "__place")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, held, key = make(), [], None

        def solve() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            texts, said = table.column(text_col).to_pylist(), table.column("__said").to_pylist()
            got = iter(answers(ask, [t for t, s in zip(texts, said, strict=True) if s]))
            out = pa.array([next(got) if s else "" for s in said], pa.string())
            return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in columns), out], [*columns, out_col])

        for frame in frames:
            ids = list(zip(frame.column(track).to_pylist(), frame.column("__batch").to_pylist(), strict=True))
            first = 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or ids[k] != ids[first]:
                    if held and ids[first] != key:
                        yield solve()
                        held = []
                    held.append(frame.slice(first, k - first))
                    key, first = ids[first], k
        if held:
            yield solve()

    kinds = dict(df.dtypes)
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{out_col}` string"]))


def map_model(df: DataFrame, make: Callable[[], Model], text_col: str = "text", out_col: str = "translated_text", batch: int = 8, keys: tuple[str, ...] = (), track: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """df with out_col. `make` builds the function once for each task; it gets up to `batch` texts at once.

    With `track`, batches hold adjoining rows of one track in `order` (see in_order): what a function of context needs. Without it
    batches hold distinct texts in no order: rows with one text (and equal `keys`, such as languages) are asked once. Texts that are
    null or blank never reach the function and give ''.
    """
    if track:
        return in_order(df, make, track, list(order), text_col, out_col, batch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for frame in batches:
            texts = frame["__text"].tolist()
            frame[out_col] = [a for start in range(0, len(texts), batch) for a in answers(ask, texts[start : start + batch])]
            yield frame

    kinds = dict(df.dtypes)
    wanted = df.select(F.col(text_col).alias("__text"), *keys).filter(F.length(clean_text("__text")) > 0).distinct()
    schema = ", ".join(["__text string", *(f"`{k}` {kinds[k]}" for k in keys), f"`{out_col}` string"])
    given = wanted.mapInPandas(run, schema)
    joined = df.join(given, [df[text_col] == given["__text"], *(df[k].eqNullSafe(given[k]) for k in keys)], "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(given[out_col], F.lit("")).alias(out_col))
