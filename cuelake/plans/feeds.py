"""Tables fed to a stream in an order that is given: each part is there, and worked off, before the next comes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import IntegerType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset a temporary one, if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='stream-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def state_partitions(spark: SparkSession) -> int:
    """Two a core, 16 at least, but no more than the session's shuffles have.

    Each state partition costs a store, its commit and a Python worker in every batch, however little it holds, so their number
    follows the cluster and not the tables; what a partition holds is sorted on disk and worked off key by key.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(16, 2 * spark.sparkContext.defaultParallelism))


def started(spark: SparkSession, writer: DataStreamWriter, partitions: int) -> StreamingQuery:
    """The stream with so many state partitions; it takes a copy of the session's settings when it starts, so these are put back at once."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, partitions)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def fed(parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame], name: str, mode: str, seen: Callable[[list], None] = lambda progress: None) -> DataFrame:
    """What a stream gives for its parts, one after the other, each with the watermark that those before it have set; `epoch` is the batch.

    Parts are written to the shared folder and streamed from there; the stream's state lives on from part to part in its checkpoint.
    seen gets the progress reports of each part.
    """
    spark = parts[0].sparkSession
    root = shared_folder(spark, name)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        out = stream(spark.readStream.schema(part.schema).parquet(f"{root}/in"))
        schema = out.schema
        q = started(spark, out.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(put).trigger(availableNow=True), state_partitions(spark))
        q.awaitTermination()
        seen(q.recentProgress)
    return spark.read.schema(schema.add("epoch", IntegerType())).option("recursiveFileLookup", True).parquet(f"{root}/out")


def by_time(rows: DataFrame, column: str, n: int) -> Column:
    """The number (0 to n - 1) of the n-th part of the table's time that each row falls in; its ends come from one aggregate."""
    low, high = rows.agg(F.unix_micros(F.min(F.col(column).cast("timestamp"))), F.unix_micros(F.max(F.col(column).cast("timestamp")))).first()
    if low is None or low == high:
        return F.lit(0)
    return F.least(F.lit(n - 1), F.floor((F.unix_micros(F.col(column).cast("timestamp")) - low) * n / (high - low))).cast("int")


def in_parts(rows: DataFrame, column: str, n: int) -> list[DataFrame]:
    """The n parts of the table's time. The rows are written to the shared folder first, so that their windows and joins run once and not for each part."""
    root = shared_folder(rows.sparkSession, "rows")
    rows.write.parquet(root)
    held = rows.sparkSession.read.schema(rows.schema).parquet(root)
    part = by_time(held, column, n)
    return [held.filter(part == k) for k in range(n)]
