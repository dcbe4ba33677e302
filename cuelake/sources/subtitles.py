"""Subtitle documents: composing. files.write_srt writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import clean_text, first_text, srt_time


def compose_srt(segments: DataFrame, mode: str = "js", tracks: DataFrame | None = None) -> DataFrame:
    """SNK-1. (track_id, srt_text), one document per track, blocks in segment order.

    The text is translated_text, else text, else ''. A null index is the position (python mode: 0 as well),
    and python mode trims the text. A track without segments, given by `tracks`, has a single newline.
    A track is bounded (9000 s of pieces of 0.4 s at least), so one row holds its blocks.
    """
    columns = segments.columns
    text = first_text(*(c for c in ("translated_text", "text") if c in columns))
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("start", "end", "index"))
    if mode == "python":
        text = clean_text(text)
        index = F.when(F.col("index") == 0, None).otherwise(F.col("index"))
    else:
        index = F.col("index")
    block = F.concat_ws("\n", F.coalesce(index, "place").cast("string"), F.concat(srt_time("start", mode), F.lit(" --> "), srt_time("end", mode)), text)
    blocks = segments.withColumn("place", place).select("track_id", F.struct("place", block.alias("block")).alias("b"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "\n\n")
    out = blocks.groupBy("track_id").agg(F.concat(joined, F.lit("\n")).alias("srt_text"))
    if tracks is not None:
        out = tracks.select("track_id").distinct().join(out, "track_id", "left").select("track_id", F.coalesce("srt_text", F.lit("\n")).alias("srt_text"))
    return out
