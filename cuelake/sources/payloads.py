"""Reading records: media catalogue, segment payloads, subtitle texts, silence logs. Bad rows get a reason, they never fail a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import SRT_TIME, clean_text, parse_srt_ms

MAX_DURATION = 9000.0
#: Texts that spell a number, or a whole one; single underscores may part digits.
SPELT = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
SPELT_WHOLE = r"^[+-]?[0-9]+(_[0-9]+)*$"


def media_catalogue(df: DataFrame, max_s: float = MAX_DURATION) -> DataFrame:
    """SRC-1. (file_name, duration_s, size_bytes) -> the rows with reject_reason; null is accepted."""
    base = F.lower(F.element_at(F.split("file_name", "/"), -1))
    d = F.col("duration_s")
    reason = (
        F.when(~F.coalesce(base.endswith(".mp4") | base.endswith(".wav"), F.lit(False)), "unsupported extension")
        .when(d.isNull() | F.isnan(d) | (d <= 0) | (d == float("inf")), "unreadable duration")
        .when(d > max_s, "over duration limit")
    )
    return df.withColumn("reject_reason", reason)


def json_number(x: Column, missing: Column, whole: bool = False) -> Column:
    """A member of an object as a number (`whole`: cut to a whole one): missing members have their default, true and false are 1 and 0, texts count if they spell a number; null, lists, objects and other texts give null."""
    kind = F.schema_of_variant(x)
    said = F.regexp_replace(clean_text(F.try_variant_get(x, "$", "string")), "_", "")
    spelt = F.when(clean_text(F.try_variant_get(x, "$", "string")).rlike(SPELT_WHOLE if whole else SPELT), said.try_cast("bigint" if whole else "double"))
    number = F.when(kind == "BIGINT", F.try_variant_get(x, "$", "bigint")).otherwise(F.try_variant_get(x, "$", "double").try_cast("bigint")) if whole else F.try_variant_get(x, "$", "double")
    return (
        F.when(x.isNull(), missing)
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number)
        .when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("int"))
        .when(kind == "STRING", spelt)
    )


def json_text(x: Column) -> Column:
    """A member of an object as trimmed text: '' if it is missing, and the words None, True and False for null, true and false."""
    kind = F.schema_of_variant(x)
    word = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(F.try_variant_get(x, "$", "string"))).otherwise(F.try_variant_get(x, "$", "string"))
    return F.when(x.isNull(), "").otherwise(clean_text(word))


def read_segments(df: DataFrame, json_col: str = "payload", with_text: bool = False) -> DataFrame:
    """SRC-2, SRC-3. Segments (track_id, index, start, end[, text]) with the track's reason: one bad element rejects all of a payload.

    A rejected track comes as one row with null segments and the reason of its first bad element. Missing times are 0, a missing index is the position;
    a null is not missing, and no number (see json_number). A payload that is no JSON, or names a member twice, has no segments.
    """
    elements = F.try_variant_get(F.try_parse_json(json_col), "$", "array<variant>")
    rows = df.select("track_id", F.posexplode_outer(elements).alias("pos", "element"))
    member = lambda c: F.try_variant_get("element", f"$.{c}", "variant")
    items = rows.select("track_id", "pos", F.coalesce(F.schema_of_variant("element").startswith("OBJECT"), F.lit(False)).alias("is_object"), *[member(c).alias(c) for c in ("index", "start", "end", "text")])
    start, end = json_number(F.col("start"), F.lit(0.0)), json_number(F.col("end"), F.lit(0.0))
    index = json_number(F.col("index"), (F.col("pos") + 1).cast("bigint"), whole=True)
    read = items.select("track_id", "pos", "is_object", index.cast("bigint").alias("index"), start.cast("double").alias("start"), end.cast("double").alias("end"), *([json_text(F.col("text")).alias("text")] if with_text else []))
    reason = (
        F.when(F.col("pos").isNull(), "At least one segment is required.")
        .when(~F.col("is_object"), "Each segment must be an object.")
        .when(F.col("start").isNull() | F.col("end").isNull(), "Segment times must be numbers.")
        .when(F.col("end") <= F.col("start"), "Segment end must be after its start.")
        .when(F.col("index").isNull(), "Segment index must be a number.")
    )
    flat = read.withColumn("reason", reason)
    verdict = F.min(F.when(F.col("reason").isNotNull(), F.struct("pos", "reason"))).over(Window.partitionBy("track_id"))["reason"]
    kept = flat.withColumn("reason", verdict).filter("reason IS NULL OR coalesce(pos, 0) = 0")
    blank = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("index", "start", "end", *(["text"] if with_text else []))]
    return kept.select("track_id", *blank, "reason")


def read_text_segments(df: DataFrame, json_col: str = "payload") -> DataFrame:
    """SRC-3."""
    return read_segments(df, json_col, with_text=True)


def srt_blocks(text: Column) -> Column:
    """The blocks of a subtitle text that aren't blank, without a byte order mark."""
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return F.filter(F.split(F.regexp_replace(clean, r"^\s+|\s+$", ""), r"\n\s*\n"), lambda b: F.length(clean_text(b)) > 0)


def parse_srt(df: DataFrame, text_col: str = "srt_text") -> DataFrame:
    """SRC-4. Cues (track_id, block_no, start_ms, end_ms, text, issue); issue says why a block makes its file invalid.

    The last line of a block with an arrow has the times; text lines are those that are neither digits
    only nor hold an arrow, so a text that is a number alone counts as an index line.
    """
    blocks = df.select("track_id", F.posexplode(srt_blocks(F.col(text_col))).alias("pos", "block"))
    lines = F.transform(F.split("block", "\n"), lambda x: clean_text(x))
    arrow = F.element_at(F.filter(lines, lambda x: x.contains("-->")), -1)
    shown = F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[0-9]+$") & ~x.contains("-->")), "\n")
    has = F.exists(lines, lambda x: x.contains("-->"))
    times = F.when(has, F.split(arrow, "-->"))
    parts = blocks.select("track_id", (F.col("pos") + 1).alias("block_no"), times.alias("times"), shown.alias("text"))
    start, end = parse_srt_ms(F.element_at("times", 1)), parse_srt_ms(F.element_at("times", 2))
    out = parts.select("track_id", "block_no", start.alias("start_ms"), end.alias("end_ms"), "text")
    issue = F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "no valid times").when(F.col("text") == "", "no subtitle text")
    return out.withColumn("issue", issue)


MARK = r"silence_(start|end): ([0-9.]+)"


def silences_from_log(lines: DataFrame) -> DataFrame:
    """SRC-7. (track_id, line_no, line) -> (track_id, k, silence_start, silence_end): each end after a start, with the last start before it."""
    order = Window.partitionBy("track_id").orderBy("line_no")
    marks = lines.select("track_id", "line_no", F.regexp_extract("line", MARK, 1).alias("kind"), F.regexp_extract("line", MARK, 2).try_cast("double").alias("t")).filter("kind <> '' AND t IS NOT NULL")
    paired = marks.withColumn("before", F.lag("kind").over(order)).withColumn("from", F.lag("t").over(order)).filter("kind = 'end' AND before = 'start'")
    return paired.select("track_id", F.row_number().over(order).alias("k"), F.col("from").alias("silence_start"), F.col("t").alias("silence_end"))


#: Pattern of the times in a subtitle file, for callers that filter before parsing.
TIME_PATTERN = SRT_TIME
