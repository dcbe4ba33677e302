"""Scalar column functions: subtitle times, sizes, progress, names, messages. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MIB = 1024 * 1024


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: Column) -> Column:
    """Round to an integer, halves upwards (also below zero)."""
    return F.floor(x + 0.5)


def one_decimal(x: Column) -> Column:
    n = half_up(x * 10).cast("long")
    return F.concat((n / 10).cast("long").cast("string"), F.lit("."), (n % 10).cast("string"))


def clean_text(text: str | Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def first_text(*texts: str | Column) -> Column:
    """The first text that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(col(t), F.lit("")) for t in texts], F.lit(""))


# FUN-1
def srt_time(seconds: str | Column, mode: str = "js") -> Column:
    """HH:MM:SS,mmm. js: half-up and never below 0; python: half-even."""
    s = col(seconds)
    ms = F.greatest(half_up(s * 1000), F.lit(0)) if mode == "js" else F.rint(s * 1000)
    ms = ms.cast("long")
    two = lambda x: F.format_string("%02d", x.cast("long"))
    return F.concat(two(F.floor(ms / 3_600_000)), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), F.format_string("%03d", ms % 1000))


SRT_TIME = r"^\s*([0-9]+):([0-9]{2}):([0-9]{2}),([0-9]{3})\s*$"


# FUN-2
def parse_srt_ms(text: str | Column) -> Column:
    """Milliseconds of a subtitle time, null where it isn't one."""
    t = col(text)
    part = lambda k: F.regexp_extract(t, SRT_TIME, k).cast("long")
    return F.when(t.rlike(SRT_TIME), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4))


def parse_srt_time(text: str | Column) -> Column:
    return parse_srt_ms(text) / 1000


def unusable(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))


# FUN-3
def format_duration(seconds: str | Column) -> Column:
    s = col(seconds).cast("double")
    n = F.floor(s)
    h, m, r = F.floor(n / 3600).cast("string"), F.floor(n % 3600 / 60).cast("string"), (n % 60).cast("string")
    return (
        F.when(unusable(s) | (s <= 0), "duration pending")
        .when(n >= 3600, F.concat(h, F.lit(" h "), m, F.lit(" min "), r, F.lit(" s")))
        .when(n >= 60, F.concat(m, F.lit(" min "), r, F.lit(" s")))
        .otherwise(F.concat(r, F.lit(" s")))
    )


# FUN-4
def format_bytes(n: str | Column, style: str = "units") -> Column:
    """units: B to GB with one decimal; report: B to MB with one decimal, null counts 0; binary: KiB and MiB, whole."""
    b = col(n)
    whole = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(f" {unit}"))
    if style == "binary":
        return F.when(b < 1024, whole(b, "B")).when(b < MIB, whole(half_up(b / 1024), "KiB")).otherwise(whole(half_up(b / MIB), "MiB"))
    if style == "report":
        b = F.coalesce(b, F.lit(0))
        return F.when(b >= MIB, F.concat(one_decimal(b / MIB), F.lit(" MB"))).when(b >= 1024, F.concat(one_decimal(b / 1024), F.lit(" KB"))).otherwise(whole(b, "B"))
    step = lambda k, unit: F.concat(one_decimal(b / 1024**k), F.lit(f" {unit}"))
    return F.when(b < 1024, whole(half_up(b), "B")).when(b < MIB, step(1, "KB")).when(b < 1024**3, step(2, "MB")).otherwise(step(3, "GB"))


# FUN-5
def clamp_percent(x: str | Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(col(x)))).cast("int")


def normalise_progress(progress: str | Column, loaded: str | Column | None = None, total: str | Column | None = None) -> Column:
    """0..1 counts as a share, anything else as percent; loaded / total stands in where progress is missing."""
    p = col(progress).cast("double")
    if loaded is not None and total is not None:
        by_size = F.when(col(total) > 0, col(loaded) / col(total) * 100)
        p = F.when(unusable(p), by_size).otherwise(p)
    return F.when(~unusable(p), clamp_percent(F.when((p >= 0) & (p <= 1), p * 100).otherwise(p)))


# FUN-6
def job_progress(stage: str | Column, done: str | Column, total: str | Column) -> Column:
    """Transcription fills 0 to 55 percent of a job, translation 55 to 90 (halves to even)."""
    s, share = col(stage), col(done) / col(total)
    return F.when(s == "transcribing", F.rint(share * 55)).when(s == "translating", 55 + F.rint(share * 35)).cast("int")


def stage_progress(stage: str | Column, progress: str | Column) -> tuple[Column, Column]:
    """(transcription percent, translation percent) of a job's progress: the inverse."""
    s, p = col(stage), clamp_percent(F.coalesce(col(progress), F.lit(0)))
    one = F.when(s == "transcribing", clamp_percent(p / 55 * 100)).when(s.isin("translating", "ready"), 100)
    two = F.when(s == "transcribing", 0).when(s == "translating", clamp_percent((p - 55) / 35 * 100)).when(s == "ready", 100)
    return one.cast("int"), two.cast("int")


def batch_progress(progress: str | Column, batch: str | Column, batches: str | Column) -> Column:
    width = 100 / col(batches)
    return F.when(col(batches) <= 1, col(progress)).otherwise(half_up(col(batch) * width + col(progress) / 100 * width)).cast("int")


def asset_progress(done_bytes: str | Column, total_bytes: str | Column) -> Column:
    return F.when(col(total_bytes) > 0, half_up(col(done_bytes) / col(total_bytes) * 100)).otherwise(100).cast("int")


# FUN-7
def truncate_message(text: str | Column, most: int = 180) -> Column:
    t = col(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def last_line(text: str | Column) -> Column:
    return F.element_at(F.split(clean_text(text), r"\r?\n"), -1)


# FUN-8
def versioned_url(url: str | Column, version: str | Column) -> Column:
    return F.concat(col(url), F.lit("?v="), F.url_encode(first_or(version, "unversioned")))


def first_or(text: str | Column, other: str) -> Column:
    return F.coalesce(F.nullif(col(text), F.lit("")), F.lit(other))


# SNK-2
def subtitle_file_name(name: str | Column, language: str | Column) -> Column:
    base = F.substring(F.regexp_replace(F.regexp_replace(col(name), r"\.[^.]+$", ""), r"[^A-Za-z0-9_-]+", "_"), 1, 20)
    return F.concat_ws(".", first_or(base, "subtitles"), col(language), F.lit("srt"))


def pair_file_name(name: str | Column, source: str | Column, target: str | Column) -> Column:
    return F.concat(F.regexp_replace(col(name), r"\.[^.]+$", ""), F.lit("."), col(source), F.lit("-"), col(target), F.lit(".srt"))


# SEG-7
def normalise_time_unit(value: str | Column, duration: str | Column, sample_rate: str | Column) -> Column:
    """A time given in seconds, milliseconds or samples, as seconds: the first reading that fits the duration."""
    v, d, r = col(value).cast("double"), col(duration), col(sample_rate)
    limit = d + F.greatest(F.lit(1.0), d * 0.05)
    fits = lambda x: (d > 0) & (x <= limit)
    return (
        F.when(unusable(v) | (v < 0), v)
        .when(fits(v), v)
        .when(fits(v / 1000), v / 1000)
        .when((r > 0) & fits(v / r), v / r)
        .when((v == F.floor(v)) & (v >= 1000), v / 1000)
        .otherwise(v)
    )


# FUN-10
STAGE_LABELS = {"audioExtraction": "Audio extraction", "vad": "VAD / segmentation", "transcription": "Transcription", "translation": "Translation", "srtFormatting": "SRT formatting"}


def mapped(key: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


def stage_text(stage: str | Column, runtime: str | Column, strategy: str | Column, endpoints: str | Column, reason: str | Column, bootstrap: str | Column | None = None) -> Column:
    """One line about a stage: label, runtime, strategy, endpoints (an array), reason and model note."""
    s = col(stage)
    parts = [
        F.coalesce(mapped(s, STAGE_LABELS), F.nullif(s, F.lit("")), F.lit("Pipeline stage")),
        F.when(col(runtime) == "browser", ": Browser").otherwise(": Python fallback"),
        F.when(F.length(col(strategy)) > 0, F.concat(F.lit(" ("), col(strategy), F.lit(")"))),
        F.when(F.size(col(endpoints)) > 0, F.concat(F.lit(" via "), F.array_join(col(endpoints), ", "))),
        F.when(F.length(col(reason)) > 0, F.concat(F.lit(" — fallback reason: "), col(reason))),
    ]
    return F.concat_ws("", *parts, *([col(bootstrap)] if bootstrap is not None else []))


def bootstrap_text(status: str | Column, remaining_bytes: str | Column, missing: str | Column) -> Column:
    """The model note of a stage: null where it has neither a status nor missing assets (an array of names)."""
    names = F.filter(col(missing), lambda x: x.isNotNull() & (x != ""))
    label = F.when(F.size(names) > 0, F.concat(F.lit(", missing "), F.array_join(names, ", "))).otherwise("")
    nothing = col(status).isNull() & (F.size(F.coalesce(col(missing), F.array().cast("array<string>"))) == 0)
    return F.when(~nothing, F.concat(F.lit(" — model bootstrap: "), first_or(status, "bootstrap-required"), F.lit(", "), format_bytes(remaining_bytes, "report"), F.lit(" remaining"), label))
