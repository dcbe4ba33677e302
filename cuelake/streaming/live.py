"""Streams: the state of jobs from their events and worker lines, and speech sessions from voiced frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.segments import MAX_SEGMENT, MIN_SEGMENT, split_long
from ..operators.windows import TERMINAL

SNAPSHOT = "job_id string, seq long, status string, stage string, progress int"
#: A bucket's jobs, one list for each column.
STATE = "job_id array<string>, seq array<long>, status array<string>, stage array<string>, progress array<int>, expires array<long>"
#: Jobs are dealt over so many buckets; one is read and written as a whole.
BUCKETS = 1024
#: The events of a bucket, one list for each column (us: their time in microseconds), and the time of the latest.
NEWS = ["job_id", "seq", "kind", "status", "stage", "progress", "us"]
PACK = "bucket int, ts timestamp, job_id array<string>, seq array<long>, kind array<string>, status array<string>, stage array<string>, progress array<int>, us array<long>"
#: So many events are packed at a time.
PACK_ROWS = 131_072
HOUR_MS = 3600 * 1000
#: How long a finished and an unfinished job is kept without news.
KEEP_TERMINAL_MS, KEEP_IDLE_MS = 24 * HOUR_MS, 7 * 24 * HOUR_MS
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(state: tuple | None, seq: int, kind: str, status: str | None, stage: str | None, progress: int | None) -> tuple | None:
    """The state (seq, status, stage, progress) after one event; cancelled absorbs, a cancel needs a known job that isn't finished, and news without a progress keeps that of the job."""
    if state and (seq <= state[0] or state[1] == "cancelled"):
        return state
    if kind == "cancel":
        return (seq, "cancelled", "cancelled", state[3]) if state and state[1] not in TERMINAL else state
    return seq, status, stage, progress


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events (bucket and NEWS) as rows of PACK, one for each bucket among PACK_ROWS events."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by("bucket").combine_chunks()
        bucket = rows["bucket"].to_numpy()
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        offsets = pa.array(np.append(starts, len(bucket)), pa.int32())
        latest = pa.array(np.maximum.reduceat(rows["us"].to_numpy(), starts), pa.timestamp("us", tz="UTC"))
        lists = [pa.ListArray.from_arrays(offsets, rows[c].chunk(0)) for c in NEWS]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), latest, *lists], names=["bucket", "ts", *NEWS])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield packed(held)
            held, n = [], 0
    if n:
        yield packed(held)


def folded(before: list[tuple | None], code: np.ndarray, seq: np.ndarray, kind: np.ndarray, status: np.ndarray, stage: np.ndarray, progress: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """fold() over the events of many jobs by columns: (number of the job, its state after them) of each that changes.

    Event i belongs to job code[i], whose state so far is before[code[i]]; events may come in any order.
    """
    known = np.array([k for k, state in enumerate(before) if state], int)
    floor = np.full(len(before), np.iinfo(np.int64).min)
    floor[known] = [before[k][0] for k in known]
    new = seq > floor[code]
    # the states so far come first, as events that aren't cancels
    had = [np.array([before[k][j] for k in known], object) for j in (1, 2, 3)]
    code, seq, cancel = np.concatenate([known, code[new]]), np.concatenate([floor[known], seq[new]]), np.concatenate([np.zeros(len(known), bool), kind[new] == "cancel"])
    order = np.lexsort((seq, code))
    code, seq, cancel = code[order], seq[order], cancel[order]
    status, stage, progress = (np.concatenate([a, b[new]])[order] for a, b in zip(had, (status, stage, progress), strict=True))
    news = ~cancel
    at = np.flatnonzero(news)
    news[at[1:][(code[at[1:]] == code[at[:-1]]) & (seq[at[1:]] == seq[at[:-1]])]] = False  # of one seq the first counts
    last = np.maximum.accumulate(np.where(news, np.arange(len(code)), -1))
    open_before = (last >= 0) & (code[last] == code) & (seq[last] < seq) & ~np.isin(status, TERMINAL)[last]
    ends = np.flatnonzero(cancel & open_before | news & (status == "cancelled"))
    at = np.flatnonzero(news)
    found = dict(zip(code[at].tolist(), at.tolist(), strict=True))  # the last of each job
    found.update(zip(code[ends][::-1].tolist(), ends[::-1].tolist(), strict=True))  # but the first that absorbs the rest
    for job, i in found.items():
        if order[i] >= len(known):
            p = progress[last[i]]
            yield job, (int(seq[i]), *(("cancelled", "cancelled") if cancel[i] else (status[i], stage[i])), None if p is None or p != p else int(p))


class JobStates(StatefulProcessor):
    """Keeps the snapshot of each job, those of a bucket of jobs in one value; a job goes when the watermark, in event time, is keep_terminal_ms past its end, or keep_idle_ms past its last event.

    Each call of the state store is a round trip to the JVM, so a bucket costs as many as one job would. Its timer stands at the time at which its first job goes.
    """

    def __init__(self, keep_terminal_ms: int, keep_idle_ms: int):
        self.keep_terminal_ms, self.keep_idle_ms = keep_terminal_ms, keep_idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", STATE)

    def held(self) -> dict[str | None, tuple]:
        """job -> (seq, status, stage, progress, expires)."""
        found = self.state.get()
        return {job: tuple(now) for job, *now in zip(*found, strict=True)} if found is not None else {}

    def keep(self, jobs: dict[str | None, tuple], before_ms: int | None) -> None:
        """Note the jobs of the bucket and move its timer, which stood at before_ms."""
        due = min((now[4] for now in jobs.values()), default=None)
        if before_ms is not None and before_ms != due:
            self.handle.deleteTimer(before_ms)
        if due is None:
            self.state.clear()
            return
        if before_ms != due:
            self.handle.registerTimer(due)
        self.state.update((list(jobs), *(list(column) for column in zip(*jobs.values(), strict=True))))

    def expires(self, now: tuple, at_ms: int) -> int:
        return at_ms + (self.keep_terminal_ms if now[1] in TERMINAL else self.keep_idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        job_id, seq, kind, status, stage, progress, us = (np.concatenate([cell for chunk in chunks for cell in chunk[c]]) for c in NEWS)
        if (late := us <= timerValues.getCurrentWatermarkInMs() * 1000).any():  # Spark drops a row of events only if all are late
            job_id, seq, kind, status, stage, progress, us = (c[~late] for c in (job_id, seq, kind, status, stage, progress, us))
        numbers: dict[str | None, int] = {}
        code = np.array([numbers.setdefault(job, len(numbers)) for job in job_id], int)
        last = np.zeros(len(numbers), np.int64)
        np.maximum.at(last, code, us // 1000)
        jobs, names = self.held(), list(numbers)
        due = min((now[4] for now in jobs.values()), default=None)
        changed = []
        for k, now in folded([jobs[job][:4] if job in jobs else None for job in names], code, seq, kind, status, stage, progress):
            jobs[names[k]] = (*now, self.expires(now, int(last[k])))
            changed.append((names[k], *now))
        if changed:
            self.keep(jobs, due)
            yield pd.DataFrame(changed, columns=["job_id", "seq", "status", "stage", "progress"]).astype({"progress": "Int32"})

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timerValues) -> None:
        jobs = self.held()
        due = min((now[4] for now in jobs.values()), default=None)
        for job, seq, status, stage, progress, ms in initial[["job_id", "seq", "status", "stage", "progress", "ms"]].itertuples(index=False, name=None):
            now = (int(seq), status, stage, None if pd.isna(progress) else int(progress))
            jobs[job] = (*now, self.expires(now, int(ms)))
        self.keep(jobs, due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.keep({job: now for job, now in self.held().items() if now[4] > watermark}, None)  # the timer that went off goes by itself
        yield from ()

    def close(self) -> None:
        return


def job_state_stream(events: DataFrame, snapshots: DataFrame | None = None, late: str = "10 minutes", keep_terminal_ms: int = KEEP_TERMINAL_MS, keep_idle_ms: int = KEEP_IDLE_MS, buckets: int = BUCKETS) -> DataFrame:
    """STR-1. Events (job_id, seq, ts TIMESTAMP, kind, status, stage, progress) -> the snapshot of each job that changed, in update mode.

    Events with a seq at or below the last one are ignored, and so are those later than the watermark. Spark hands rows to Python one by one, so events
    travel packed, a row of lists for each bucket. A job is dropped from the state when the watermark
    is keep_terminal_ms past its end, or keep_idle_ms past its last event if it never ended. `snapshots` (the rows of
    WIN-2: job_id, seq, status, stage, progress, updated_at) are the jobs known before the stream began. The session's state
    store becomes RocksDB, which timers need. Jobs are dealt by hash over `buckets`, which a checkpoint holds: a stream keeps the number it began with.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    dealt = lambda rows: rows.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
    columns = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("seq").cast("long").alias("seq"), "kind", "status", "stage", F.col("progress").cast("int").alias("progress"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = dealt(columns).mapInArrow(pack, PACK).withWatermark("ts", late)
    first = None
    if snapshots is not None:
        known = snapshots.select(F.col("job_id").cast("string").alias("job_id"), F.col("seq").cast("long").alias("seq"), "status", "stage", F.col("progress").cast("int").alias("progress"), F.unix_millis(F.col("updated_at").cast("timestamp")).alias("ms"))
        first = dealt(known).groupBy("bucket")
    return rows.groupBy("bucket").transformWithStateInPandas(JobStates(keep_terminal_ms, keep_idle_ms), StructType.fromDDL(SNAPSHOT), "Update", "EventTime", first)


def with_share(rows: DataFrame, line_col: str) -> DataFrame:
    """rows with __share, done by total of a line that is a JSON object with such numbers; a line is parsed once for it."""
    p = F.from_json(F.col(line_col), "done double, total double")
    return rows.withColumn("__share", F.transform(F.array(p), lambda x: F.when(x["total"] > 0, x["done"] / x["total"]))[0])


def percent_done() -> Column:
    share = F.col("__share")
    return F.when(F.col("stage") == "translating", 55 + F.rint(share * 35)).otherwise(F.rint(share * 55)).cast("int")


def progress_events(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Worker lines (job_id, seq, ts, stage, line) as progress events: JSON objects with numbers done and total; other lines are skipped."""
    return with_share(lines, line_col).filter("__share IS NOT NULL").select("job_id", "seq", "ts", F.lit("progress").alias("kind"), F.lit("running").alias("status"), "stage", percent_done().alias("progress"))


def job_state_of_lines(events: DataFrame, lines: DataFrame | None = None, line_col: str = "line", **options) -> DataFrame:
    """STR-1 with the workers' own lines: both streams go through one state, in the order of their seq.

    Without `lines` the one stream holds both, its events with a null line, and is read once."""
    columns = ["job_id", "seq", "ts", "kind", "status", "stage", "progress"]
    if lines is not None:
        return job_state_stream(events.select(*columns).unionByName(progress_events(lines, line_col).select(*columns)), **options)
    said = F.col(line_col).isNotNull()
    rows = with_share(events, line_col).filter(~said | F.col("__share").isNotNull())
    told = {"kind": F.lit("progress"), "status": F.lit("running"), "progress": percent_done()}
    return job_state_stream(rows.select(*(F.when(said, told[c]).otherwise(F.col(c)).alias(c) if c in told else c for c in columns)), **options)


def speech_sessions_stream(frames: DataFrame, noise_db: float = -35.0, gap: str = "450 milliseconds", late: str = "10 seconds", min_s: float = MIN_SEGMENT, max_s: float = MAX_SEGMENT) -> DataFrame:
    """STR-2. Voiced frames (track_id, ts TIMESTAMP, level_db) closer than the gap form a session; sessions under min_s go,
    longer ones than max_s are cut. Frames later than the watermark are dropped. Times are seconds of the epoch."""
    voiced = frames.filter(F.col("level_db") > noise_db).withWatermark("ts", late)
    sessions = voiced.groupBy("track_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_frames"), F.max("ts").alias("last"))
    spans = sessions.select("track_id", "n_frames", F.unix_micros("w.start").alias("low"), F.unix_micros("last").alias("high")).filter(F.col("high") - F.col("low") >= round(min_s * 1e6))
    return split_long(spans.select("track_id", "n_frames", (F.col("low") / 1_000_000).alias("start"), (F.col("high") / 1_000_000).alias("end")), max_s, min_s)
