"""Predicates that give a reason (null: accepted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import first_text
from .windows import STAGES

RUNTIMES = ("browser", "python-fallback", "server-fallback")
SEGMENT_KEYS = ("index", "start", "end", "text")
#: Limits of the stages that can run in a browser.
EXTRACTION_BYTES, EXTRACTION_S = 800 * 1024 * 1024, 3600.0
TRANSCRIPTION_BYTES, TRANSCRIPTION_S, SEGMENTS = 250 * 1024 * 1024, 900.0, 300


def valid_ids(df: DataFrame, col: str = "id") -> DataFrame:
    """FIL-1."""
    return df.filter(F.col(col).rlike(r"^[a-f0-9]{32}\z"))


def check_language_request(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """FIL-2. (source, target) rows with a reason; pairs: the supported (source, target), distinct."""
    known = pairs.select("source", "target", F.lit(True).alias("__known"))
    reason = (
        F.when((first_text("source") == "") | (first_text("target") == ""), "Source and target languages are required.")
        .when(F.col("source") == F.col("target"), "Source and target languages must differ.")
        .when(F.col("__known").isNull(), "Unsupported language pair.")
    )
    return requests.join(known, ["source", "target"], "left").withColumn("reason", reason).drop("__known")


def route_by_limits(requests: DataFrame) -> DataFrame:
    """FIL-3. requests: (stage, duration_s, size_bytes, n_segments); runtime and reason. Limits are strict, a missing value passes, NaN and infinity don't."""
    d, b, n = F.col("duration_s"), F.col("size_bytes"), F.col("n_segments")
    odd = F.coalesce(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(False))
    reason = (
        F.when((F.col("stage") == "audioExtraction") & (b > EXTRACTION_BYTES), "file too large")
        .when((F.col("stage") == "audioExtraction") & odd, "duration unknown")
        .when((F.col("stage") == "audioExtraction") & (d > EXTRACTION_S), "duration over limit")
        .when((F.col("stage") == "transcription") & (odd | (d > TRANSCRIPTION_S)), "duration over limit")
        .when((F.col("stage") == "transcription") & (b > TRANSCRIPTION_BYTES), "audio too large")
        .when(F.col("stage").isin("transcription", "translation") & (n > SEGMENTS), "too many segments")
    )
    return requests.withColumn("reason", reason).withColumn("runtime", F.when(F.col("reason").isNull(), "browser").otherwise("server-fallback"))


def split_diagnostics(df: DataFrame, json_col: str = "segment") -> DataFrame:
    """FIL-4. (track_id, position, JSON object) -> the known columns, the other keys as a map, and a reject reason."""
    kept = F.from_json(F.col(json_col), "map<string,string>")
    out = df.withColumn("__m", kept)
    start, end = (F.col("__m")[k].try_cast("double") for k in ("start", "end"))
    other = F.map_filter("__m", lambda k, v: ~k.isin(*SEGMENT_KEYS))
    return out.select("track_id", "position", F.col("__m")["index"].try_cast("int").alias("index"), start.alias("start"), end.alias("end"), F.col("__m")["text"].alias("text"), other.alias("diagnostics"), F.when(start.isNull() | end.isNull(), "numeric start and end required").alias("reject"))


def check_stage_results(df: DataFrame) -> DataFrame:
    """FIL-5. (stage, runtime, strategy, payload, metadata as JSON objects) with violation and, for audio, storage."""
    payload, metadata = (F.from_json(F.col(c), "map<string,string>") for c in ("payload", "metadata"))
    audio, blob = payload["audioId"], payload["audioBlob"]
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    is_object = lambda c: F.coalesce(F.ltrim(F.col(c)).startswith("{"), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False)), "invalid stage")
        .when(~F.coalesce(F.col("runtime").isin(*RUNTIMES), F.lit(False)), "invalid runtime")
        .when(none(F.col("strategy")), "strategy required")
        .when(~is_object("payload") | payload.isNull(), "payload must be an object")
        .when(~is_object("metadata") | metadata.isNull(), "metadata must be an object")
        .when((F.col("stage") == "audioExtraction") & none(audio) & none(blob), "audio reference required")
        .when((F.col("stage") == "srtFormatting") & payload["srtText"].isNull(), "srt text required")
    )
    inferred = F.when(~none(blob), "browser").when(~none(audio) | (F.col("runtime") != "browser"), "server").otherwise("none")
    storage = F.when(F.col("stage") == "audioExtraction", F.coalesce(payload["storage"], inferred))
    return df.withColumn("violation", reason).withColumn("storage", storage)
