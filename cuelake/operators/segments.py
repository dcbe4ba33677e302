"""Operators on time spans of tracks. Spans are half-open, in seconds; inside, times are whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_SEGMENT, MIN_SEGMENT = 12.0, 0.4
NOISE_DB, MIN_SILENCE = -35.0, 0.45


def us(seconds: str | Column) -> Column:
    """Seconds as whole microseconds."""
    return F.round((F.col(seconds) if isinstance(seconds, str) else seconds) * 1_000_000).cast("long")


def seconds(micros: Column) -> Column:
    return micros / 1_000_000


def silences_from_frames(frames: DataFrame, noise_db: float = NOISE_DB, min_s: float = MIN_SILENCE) -> DataFrame:
    """SEG-1. Runs of frames (track_id, t, level_db) at or below the noise level, from the first frame's time to the
    time of the first louder frame (or the last frame of the track), that last min_s at least; k counts them per track."""
    by_time = Window.partitionBy("track_id").orderBy("t", "level_db")
    quiet = F.col("level_db") <= noise_db
    marked = frames.select("track_id", "t", quiet.alias("quiet"), F.coalesce(F.lead("t").over(by_time), F.col("t")).alias("until"), (quiet != F.coalesce(F.lag(quiet).over(by_time), ~quiet)).cast("int").alias("turn"), "level_db")
    islands = marked.withColumn("island", F.sum("turn").over(by_time)).filter("quiet").groupBy("track_id", "island").agg(F.min("t").alias("silence_start"), F.max("until").alias("silence_end"))
    kept = islands.filter(us("silence_end") - us("silence_start") >= round(min_s * 1e6))
    return kept.select("track_id", F.row_number().over(Window.partitionBy("track_id").orderBy("silence_start")).alias("k"), "silence_start", "silence_end")


def speech_from_silences(silences: DataFrame, tracks: DataFrame, min_s: float = MIN_SEGMENT) -> DataFrame:
    """SEG-2. What is left of each track between its silences, in pieces of min_s at least; the whole track where nothing is."""
    least = round(min_s * 1e6)
    earlier = Window.partitionBy("track_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inner = silences.select("track_id", "k", us("silence_start").alias("until"), F.coalesce(F.max(us("silence_end")).over(earlier), F.lit(0)).alias("low"))
    inner = inner.join(tracks.select("track_id"), "track_id", "left_semi").select("track_id", "low", F.col("until").alias("high"))
    last = silences.groupBy("track_id").agg(F.max(us("silence_end")).alias("low"))
    tail = tracks.join(last, "track_id", "left").select("track_id", F.greatest(F.coalesce("low", F.lit(0)), F.lit(0)).alias("low"), us("duration_s").alias("high"))
    speech = inner.unionByName(tail).filter(F.col("high") - F.col("low") >= least)
    whole = tracks.filter("duration_s > 0").join(speech.select("track_id").distinct(), "track_id", "left_anti").select("track_id", F.lit(0).cast("long").alias("low"), us("duration_s").alias("high"))
    return speech.unionByName(whole).select("track_id", seconds(F.col("low")).alias("start"), seconds(F.col("high")).alias("end"))


def split_long(segments: DataFrame, max_s: float = MAX_SEGMENT, min_s: float = MIN_SEGMENT, strict: bool = False) -> DataFrame:
    """SEG-3. Pieces of max_s while more than that is left; a last piece under min_s goes. Other columns stay.

    strict: rows whose bounds aren't finite or whose end isn't after the start go; max_s <= 0 changes nothing.
    """
    rows = segments
    if strict:
        rows = rows.filter("start IS NOT NULL AND end IS NOT NULL AND NOT isnan(start) AND NOT isnan(end) AND abs(start) < double('inf') AND abs(end) < double('inf') AND end > start")
        if max_s <= 0:
            return rows
    step, least = round(max_s * 1e6), round(min_s * 1e6)
    length = us("end") - us("start")
    pieces = rows.withColumn("__pieces", F.greatest(F.lit(0), F.ceil(length / step) - 1).cast("int")).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__pieces"))))
    low = us("start") + F.col("__k") * F.lit(step).cast("long")
    last = F.col("__k") == F.col("__pieces")
    cut = pieces.withColumn("__low", low).withColumn("__high", F.when(last, us("end")).otherwise(low + step)).filter(~last | (F.col("__high") - F.col("__low") >= least))
    return cut.withColumn("start", seconds(F.col("__low"))).withColumn("end", seconds(F.col("__high"))).drop("__pieces", "__k", "__low", "__high")


def numbered(segments: DataFrame) -> DataFrame:
    """A dense 1-based index per track by start, times to three decimals, and a standing text."""
    index = F.row_number().over(Window.partitionBy("track_id").orderBy("start", "end"))
    out = segments.select("track_id", index.alias("index"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))
    return out.withColumn("text", F.concat(F.lit("Speech segment "), F.col("index")))


def segment_tracks(silences: DataFrame, tracks: DataFrame) -> DataFrame:
    """SEG-4."""
    return numbered(split_long(speech_from_silences(silences, tracks)))


def fixed_segments(tracks: DataFrame, size_s: float = MAX_SEGMENT) -> DataFrame:
    """SEG-5. Cuts of a fixed size; one piece at least."""
    step = round(size_s * 1e6)
    n = F.greatest(F.lit(1), F.ceil(us("duration_s") / step))
    k = tracks.withColumn("k", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return k.select("track_id", (F.col("k") + 1).alias("index"), seconds(F.col("k") * F.lit(step).cast("long")).alias("start"), seconds(F.least(us("duration_s"), (F.col("k") + 1) * F.lit(step).cast("long"))).alias("end"))


def sample_windows(tracks: DataFrame, n: int = 5, len_s: float = 30.0) -> DataFrame:
    """SEG-6. Evenly spaced windows of min(len_s, duration); one where there is no room, one in the middle where n <= 1."""
    known = tracks.filter("duration_s > 0").withColumn("length", F.least(F.lit(len_s), F.col("duration_s"))).withColumn("room", F.col("duration_s") - F.col("length"))
    many = F.lit(max(n, 1) - 1)
    k = known.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("room") <= 0, 0).otherwise(many))))
    start = F.when(F.col("room") <= 0, F.lit(0.0)).otherwise(F.col("room") / 2 if n <= 1 else F.round(F.col("room") * F.col("k") / (n - 1), 3))
    return k.select("track_id", (F.col("k") + 1).alias("sample_no"), start.alias("start"), "length")


def slice_samples(segments: DataFrame, signals: DataFrame) -> DataFrame:
    """SEG-8. The samples of each segment, by signals (track_id, rate, pcm ARRAY); no start counts 0, no end the start."""
    both = segments.join(signals, "track_id")
    low = F.greatest(F.lit(0), F.floor(F.coalesce("start", F.lit(0.0)) * F.col("rate"))).cast("int")
    high = F.least(F.size("pcm"), F.ceil(F.coalesce("end", "start", F.lit(0.0)) * F.col("rate"))).cast("int")
    return both.withColumn("samples", F.slice("pcm", low + 1, F.greatest(F.lit(0), high - low))).drop("pcm", "rate")


def slice_long_samples(segments: DataFrame, samples: DataFrame, rates: DataFrame, bucket_s: float = 12.0) -> DataFrame:
    """SEG-8 for long signals (track_id, sample_no, value): one row for each sample of each segment.

    Both sides carry the number of a time bucket, so the range join is an equi-join with a remainder;
    a segment is repeated once for each bucket that it touches.
    """
    at = lambda *times: us(F.coalesce(*times, F.lit(0.0))) * F.col("rate") / 1_000_000  # noqa: E731  # whole microseconds: seconds times a rate may fall short of a whole sample
    rated = segments.join(rates, "track_id").withColumn("__low", F.greatest(F.lit(0), F.floor(at("start")))).withColumn("__high", F.ceil(at("end", "start"))).filter("__high > __low")
    width = (F.col("rate") * bucket_s).cast("long")
    spread = rated.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor((F.col("__high") - 1) / width))))
    placed = samples.join(rates, "track_id").withColumn("__bucket", F.floor(F.col("sample_no") / width)).drop("rate")
    return spread.join(placed, ["track_id", "__bucket"]).filter("sample_no >= __low AND sample_no < __high").drop("__low", "__high", "__bucket", "rate")


def review_segments(segments: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """SEG-9. Number, sum and mean of lengths per track; zeros for tracks without segments."""
    length = F.greatest(F.lit(0), us("end") - us("start"))
    found = segments.groupBy("track_id").agg(F.count("*").alias("n"), F.sum(length).alias("total"))
    if tracks is not None:
        found = tracks.select("track_id").distinct().join(found, "track_id", "left").na.fill(0, ["n", "total"])
    return found.select("track_id", "n", seconds(F.col("total")).alias("speech_s"), F.when(F.col("n") > 0, seconds(F.col("total")) / F.col("n")).otherwise(0.0).alias("avg_s"))
