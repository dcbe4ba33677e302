"""Joins of segments, languages, assets and stage results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import clean_text, first_or, first_text, versioned_url

PIVOT = "en"
#: Fixed catalogue: code and name.
LANGUAGES = (
    ("en", "English"), ("zh", "Chinese"), ("hi", "Hindi"), ("es", "Spanish"), ("fr", "French"), ("ar", "Arabic"), ("bn", "Bengali"), ("pt", "Portuguese"), ("ru", "Russian"), ("ur", "Urdu"),
    ("id", "Indonesian"), ("de", "German"), ("ja", "Japanese"), ("sw", "Swahili"), ("mr", "Marathi"), ("te", "Telugu"), ("tr", "Turkish"), ("ta", "Tamil"), ("it", "Italian"), ("uk", "Ukrainian"),
)
MODEL_TAGS = (("en", "eng_Latn"), ("fr", "fra_Latn"))
FALLBACK_STRATEGY = "python-backend"


def attach_transcripts(segments: DataFrame, transcripts: DataFrame, keep_blank: bool = True) -> DataFrame:
    """JOI-1. The recognised text by (track_id, index); the times stay the segment's, a missing text is ''.

    A null or 0 index of a segment is its position. keep_blank=False keeps rows with a text or end > start only.
    """
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("start", "end"))
    own = segments.drop("text").withColumn("index", F.coalesce(F.nullif("index", F.lit(0)), place))
    out = own.join(transcripts.select("track_id", "index", "text"), ["track_id", "index"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return out if keep_blank else out.filter("trim(text) <> '' OR end > start")


def attach_translations(segments: DataFrame, translations: DataFrame, mode: str = "add") -> DataFrame:
    """JOI-2. translations (track_id, index, translated_text, seq): the last row of an index wins, no row gives ''.

    add: translated_text next to text, '' for blank texts; replace: the translation takes the place of the text.
    """
    last = translations.groupBy("track_id", "index").agg(F.max_by("translated_text", "seq").alias("translated_text"))
    out = segments.join(last, ["track_id", "index"], "left").withColumn("translated_text", F.coalesce("translated_text", F.lit("")))
    if mode == "replace":
        return out.withColumn("text", F.col("translated_text")).drop("translated_text")
    return out.withColumn("translated_text", F.when(clean_text("text") == "", "").otherwise(F.col("translated_text")))


def supported_pairs(direct: DataFrame, pivot: str = PIVOT) -> DataFrame:
    """JOI-3. Direct pairs without identity, and every source -> pivot -> target; distinct and sorted.

    The two sides of the pivot meet by an equi-join on it; both hold a row for each language at most.
    """
    pairs = direct.filter("source <> target").select("source", "target").distinct()
    into = pairs.filter(F.col("target") == pivot).select("source", F.col("target").alias("pivot"))
    out_of = pairs.filter(F.col("source") == pivot).select(F.col("source").alias("pivot"), "target")
    return pairs.union(into.join(out_of, "pivot").filter("source <> target").select("source", "target")).distinct().orderBy("source", "target")


def resolve_routes(requests: DataFrame, direct: DataFrame, pivot: str = PIVOT) -> DataFrame:
    """JOI-4. requests (source, target) -> route direct / pivot / none and the hops."""
    pairs = direct.select("source", "target").distinct()
    one = pairs.withColumn("__direct", F.lit(True))
    first = pairs.filter(F.col("target") == pivot).select("source", F.lit(True).alias("__first"))
    second = pairs.filter(F.col("source") == pivot).select("target", F.lit(True).alias("__second"))
    out = requests.join(one, ["source", "target"], "left").join(first, "source", "left").join(second, "target", "left")
    by_pivot = F.col("__first") & F.col("__second") & (F.col("source") != pivot) & (F.col("target") != pivot)
    route = F.when(F.col("__direct"), "direct").when(by_pivot, "pivot").otherwise("none")
    hops = F.when(route == "direct", F.array("source", "target")).when(route == "pivot", F.array(F.col("source"), F.lit(pivot), F.col("target"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("route", route).withColumn("hops", hops).drop("__direct", "__first", "__second")


def with_cached(manifest: DataFrame, cached: DataFrame, version: str) -> DataFrame:
    """Required assets with their versioned URL and whether it is in cached (url)."""
    wanted = manifest.filter("coalesce(required, true)").withColumn("versioned_url", versioned_url("url", F.lit(version)))
    seen = cached.select(F.col("url").alias("versioned_url"), F.lit(True).alias("cached")).distinct()
    return wanted.join(seen, "versioned_url", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def missing_assets(manifest: DataFrame, cached: DataFrame, version: str) -> DataFrame:
    """JOI-5."""
    wanted = manifest.filter("coalesce(required, true)").withColumn("versioned_url", versioned_url("url", F.lit(version)))
    left = wanted.join(cached.select(F.col("url").alias("versioned_url")), "versioned_url", "left_anti")
    return left.select("stage", first_or("name", "").alias("name"), "versioned_url", "bytes", "sha256", F.lit(True).alias("retryable"))


def verify_assets(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """JOI-6. One row (source_manifest, position, issue) for each issue. manifest: (source_manifest, position, url, bytes, sha256), a
    manifest without assets being one row with a null position; inventory: (url, bytes, sha256)."""
    found = inventory.select("url", F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha"))
    rows = manifest.join(found, "url", "left")
    url, blank = F.col("url"), first_text("url") == ""
    remote = F.coalesce(url.rlike(r"^https?://") | url.startswith("//"), F.lit(False))
    there = ~blank & ~remote & F.col("__bytes").isNotNull()
    no_sum, no_size = first_text("sha256") == "", F.col("bytes").isNull() | (F.col("bytes") <= 0)
    issues = F.array(
        F.when(blank, "url is required").when(remote, "remote asset URL").when(F.col("__bytes").isNull(), "packaged file is missing"),
        F.when(no_sum, "sha256 is required"),
        F.when(no_size, "bytes must be a positive integer"),
        F.when(there & ~no_size & (F.col("__bytes") != F.col("bytes")), "bytes mismatch"),
        F.when(there & ~no_sum & (F.col("__sha") != F.col("sha256")), "sha256 mismatch"),
    )
    listed = F.when(F.col("position").isNull(), F.array(F.lit("must list packaged assets"))).otherwise(F.array_compact(issues))
    return rows.select("source_manifest", "position", F.posexplode(listed).alias("n", "issue")).orderBy("source_manifest", "position", "n").drop("n")


def assets_verdicts(expected: DataFrame, present: DataFrame, issues: DataFrame) -> DataFrame:
    """JOI-6, the verdicts: (source_manifest, issues, verdict) for each manifest expected, and as a row without one over all.

    skip where a manifest isn't present or an issue stands, else ready.
    """
    counted = issues.groupBy("source_manifest").agg(F.count("*").alias("issues"))
    there = present.select("source_manifest").distinct().withColumn("there", F.lit(True))
    rows = expected.select("source_manifest").distinct().join(there, "source_manifest", "left").join(counted, "source_manifest", "left")
    out = rows.rollup("source_manifest").agg(F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"), F.count_if(F.col("there").isNull()).alias("absent"))
    return out.select("source_manifest", "issues", F.when((F.col("issues") > 0) | (F.col("absent") > 0), "skip").otherwise("ready").alias("verdict"))


def coalesce_runs(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """JOI-7. Per run and stage the browser's result where it is declared and succeeded, else the fallback's, else an error.

    primary: (run_id, stage, declared, payload, error, strategy); fallback: (run_id, stage, payload).
    """
    p = primary.select("run_id", "stage", F.col("declared").alias("__declared"), F.col("payload").alias("__own"), F.col("error").alias("__error"), F.col("strategy").alias("__strategy"))
    f = fallback.select("run_id", "stage", F.col("payload").alias("__other"))
    both = p.join(f, ["run_id", "stage"], "full_outer")
    declared = F.coalesce("__declared", F.lit(False))
    won = declared & F.col("__error").isNull() & F.col("__own").isNotNull()
    failed = declared & ~won
    return both.select(
        "run_id", "stage",
        F.when(won, F.col("__own")).otherwise(F.col("__other")).alias("payload"),
        F.when(won, "browser").when(F.col("__other").isNotNull(), "server-fallback").otherwise("error").alias("runtime"),
        F.when(failed, FALLBACK_STRATEGY).otherwise(F.coalesce("__strategy", F.lit("unavailable"))).alias("strategy"),
        F.when(failed, F.coalesce("__error", F.lit("no result"))).alias("reason"),
        F.when(failed & (F.col("__strategy") != "unavailable"), F.col("__strategy")).alias("attempted_strategy"),
    )


def language_names(df: DataFrame, catalogue: DataFrame, code_col: str = "code", default: str = "") -> DataFrame:
    """JOI-8. name (null and reject where the code is unknown) and the model's tag for the code: its own, else the code, else the default."""
    names = catalogue.select(F.col("code").alias(code_col), "name")
    tag = F.coalesce(*[F.when(F.lower(code_col) == c, t) for c, t in MODEL_TAGS], F.nullif(F.col(code_col), F.lit("")), F.lit(default))
    return df.join(names, code_col, "left").withColumn("reject", F.when(F.col("name").isNull(), "unknown language")).withColumn("model_tag", tag)
