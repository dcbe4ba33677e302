"""Operators that are a window function, an order or a set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STAGES = ("audioExtraction", "vad", "transcription", "translation", "srtFormatting")
TERMINAL = ("succeeded", "failed", "cancelled")


def numbered(rows: DataFrame, track: str, order: list[str], size: int, batch: str = "batch", place: str = "place") -> DataFrame:
    """rows with their place (from 0) in their track and the number of their batch of `size`; a size under 1 makes one batch."""
    at = F.row_number().over(Window.partitionBy(track).orderBy(*order)) - 1
    return rows.withColumn(place, at).withColumn(batch, (F.floor(F.col(place) / size) if size >= 1 else F.lit(0)).cast("int"))


def batch_numbers(segments: DataFrame, size: int = 8) -> DataFrame:
    """WIN-1. Order-preserving batches of `size` rows per track; a size under 1 makes one batch."""
    return numbered(segments, "track_id", ["index"], size, "batch", "__place").drop("__place")


def effective_events(events: DataFrame) -> DataFrame:
    """Events up to and with the first cancel that counts: one that follows a state that isn't terminal.

    A cancel of an unknown job or of a finished one changes nothing; one that counts keeps the progress.
    """
    before = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("kind") != "cancel", F.col("status")), ignorenulls=True).over(before)
    counts = (F.col("kind") == "cancel") & state.isNotNull() & ~state.isin(*TERMINAL)
    progress = F.last(F.when(F.col("kind") != "cancel", F.col("progress")), ignorenulls=True).over(before)
    marked = events.withColumn("__cancels", counts).withColumn("progress", F.when(F.col("kind") == "cancel", progress).otherwise(F.col("progress")))
    first = F.min(F.when(F.col("__cancels"), F.col("seq"))).over(Window.partitionBy("job_id"))
    kept = marked.withColumn("__first", first).filter("(kind <> 'cancel' AND (__first IS NULL OR seq < __first)) OR (__cancels AND seq = __first)")
    cancelled = F.col("kind") == "cancel"
    return kept.withColumn("status", F.when(cancelled, "cancelled").otherwise(F.col("status"))).withColumn("stage", F.when(cancelled, "cancelled").otherwise(F.col("stage"))).drop("__cancels", "__first")


def job_snapshots(events: DataFrame) -> DataFrame:
    """WIN-2. The latest state of each job, after the events (job_id, seq, ts, kind, status, stage, progress)."""
    last = effective_events(events).groupBy("job_id").agg(F.max_by(F.struct("seq", "status", "stage", "progress", "ts"), "seq").alias("last"), F.min("ts").alias("created_at"))
    return last.select("job_id", "last.seq", "last.status", "last.stage", "last.progress", "created_at", F.col("last.ts").alias("updated_at"))


def list_jobs(snapshots: DataFrame) -> DataFrame:
    """SRT-1. Newest first; a missing creation time counts as the oldest; ties by id."""
    return snapshots.orderBy(F.coalesce(F.col("created_at").cast("double"), F.lit(0.0)).desc(), "job_id")


def stage_rank(stage: str | Column, order: tuple[str, ...] = STAGES, other: int = 99) -> Column:
    at = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(stage) if isinstance(stage, str) else stage)
    return F.when(at > 0, at - 1).otherwise(other).cast("int")


def stage_sort(df: DataFrame, order: tuple[str, ...] = STAGES, *more: str) -> DataFrame:
    """SRT-2. Rows in the fixed order of stages, unknown ones last."""
    return df.orderBy(stage_rank("stage", order), *more)


def language_backlog(catalogue: DataFrame, available: DataFrame, missing: DataFrame, source: str = "en") -> DataFrame:
    """SET-1. (issue, code) rows. catalogue(code), available(code, prepared, validated), missing(code, priority, package).

    Available and missing codes together are the catalogue without the source; validated and missing
    codes don't meet; prepared codes that aren't validated are missing ones; priorities run 1 to n;
    packages are named after the pivot.
    """
    targets = catalogue.filter(F.col("code") != source).select("code")
    listed = available.filter("validated").select("code").union(missing.select("code")).distinct()
    issue = lambda df, text: df.select(F.lit(text).alias("issue"), "code")
    ranked = missing.withColumn("place", F.row_number().over(Window.orderBy("priority", "code")))  # a catalogue of languages is small
    parts = [
        issue(targets.exceptAll(listed.intersect(targets)), "not covered"),
        issue(listed.subtract(targets), "not in catalogue"),
        issue(available.filter("validated").select("code").intersect(missing.select("code")), "validated and missing"),
        issue(available.filter("prepared AND NOT validated").select("code").subtract(missing.select("code")), "prepared but not in backlog"),
        issue(ranked.filter("priority <> place"), "priority gap"),
        issue(missing.filter(F.col("package") != F.concat(F.lit(f"translate-{source}_"), F.col("code"))), "unexpected package"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
