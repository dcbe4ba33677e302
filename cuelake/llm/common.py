"""What the operators of this subpackage share: input tables, written stages, byte helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The white space that separates words wherever an operator counts or shingles them.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir; where that is unset a temporary one, if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN_ROOT:
            _OWN_ROOT.append(f"file://{tempfile.mkdtemp(prefix='stage-')}")
        root = _OWN_ROOT[0]
    return root.rstrip("/")


_OWN_ROOT: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: all that came of them has been written in its turn."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch that goes to Python.
BATCH_BYTES = "1m"
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES go to Python, where the session sets no limit of its own: rows with whole texts fill a task's memory long before they are as many as Spark's default."""
    if spark.conf.get(_BATCHES, None) is None:
        spark.conf.set(_BATCHES, BATCH_BYTES)


def give_back() -> None:
    """Free memory goes back to the system: a Python worker lives on after its task, and what it holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        return


def frugal(run):
    """run, giving memory back after every batch."""

    def one_by_one(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch
            del batch
            give_back()

    return lambda batches: run(one_by_one(batches))


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInPandas in bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInPandas(frugal(run), schema)


def arrow_mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow in bounded batches: columns that are handed on keep their type and their nulls."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(frugal(run), schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of a multiply-xorshift hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2 ** 64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, m, dtype=np.uint64)]), dtype=np.uint64) for m in (np.uint64(MULTIPLIER), np.uint64(INVERSE))]
    return _POWERS[0], _POWERS[1]


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, 64-bit hash) of every word of a byte array: one running sum serves all words."""
    space = np.concatenate([[True], IS_SPACE[b], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    up, down = powers(len(b) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), ((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)]).cumsum(dtype=np.uint64)])
    return starts, ends, mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_CLASSES: dict[tuple[str, ...], np.ndarray] = {}


def code_point_classes(patterns: tuple[str, ...]) -> np.ndarray:
    """For each code point 1 + the number of the first pattern that its character matches, or 0."""
    if patterns not in _CLASSES:
        own = np.zeros(0x110000, dtype=np.uint8)
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            every = "".join(map(chr, range(low, high)))
            for k, pattern in reversed(list(enumerate(patterns, 1))):
                for m in regex.finditer(pattern, every):
                    own[low + m.start() : low + m.end()] = k
        _CLASSES[patterns] = own
    return _CLASSES[patterns]


def bucket_of(column: str, modulus: int):
    """crc32 of an id as text, modulo: the deal of documents into folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def as_bytes(text) -> bytes:
    """UTF-8 of a text; null (None or NaN from pandas) counts as empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def as_text(text) -> str:
    return text if isinstance(text, str) else ""


def pack_text(text) -> bytes:
    """A text as it travels through a shuffle: zstd shrinks it to less than half, the shuffle's own codec to two thirds."""
    return _COMPRESS.compress(as_bytes(text))


def unpack_text(packed: bytes) -> bytes:
    return _DECOMPRESS.decompress(packed)


_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(df: DataFrame, keep: list[str]) -> DataFrame:
    """df's `keep` columns and its text, packed, as `packed`."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keep].copy()
            out["packed"] = [pack_text(t) for t in batch["text"]]
            yield out

    return mapped(df.select(*keep, "text"), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", packed binary")
