"""Aggregations: language votes, subtitle diagnostics and comparison, asset and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import STAGE_LABELS, clean_text, first_text, mapped
from ..sources.payloads import parse_srt, srt_blocks
from .joins import with_cached
from .windows import STAGES, stage_rank

#: Fixed stop words of the text comparison.
STOP_WORDS = (
    "the", "and", "that", "for", "you", "with", "this", "are", "was", "were", "but", "not", "all", "can", "its", "into", "from", "have", "has", "had", "his", "her", "our", "your",
)
#: Fixed service endpoints of the stages that fall back.
ENDPOINTS = {
    "audioExtraction": ["POST /api/extract-audio"],
    "vad": ["POST /api/segment-audio"],
    "transcription": ["POST /api/transcribe-audio", "POST /api/subtitle-jobs", "GET /api/subtitle-jobs/{jobId}"],
    "translation": ["POST /api/translate-segments", "POST /api/subtitle-jobs", "GET /api/subtitle-jobs/{jobId}"],
}
COVERAGE, MAX_BLOCK_DELTA, MAX_END_DELTA_MS, MIN_SIMILARITY = 0.85, 2, 5000, 0.90


def vote_language(clips: DataFrame) -> DataFrame:
    """AGG-1. (track_id, clip_no, language_code, probability) -> winner by votes, then probability sum, then first clip; its mean
    probability and the votes of all languages. Tracks without a vote have no row."""
    per = clips.filter(F.trim(F.coalesce("language_code", F.lit(""))) != "").groupBy("track_id", "language_code").agg(F.count("*").alias("n"), F.sum("probability").alias("p"), F.min("clip_no").alias("first"))
    best = F.struct("n", "p", (-F.col("first")).alias("early"), "language_code")
    out = per.groupBy("track_id").agg(F.max(best).alias("w"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("language_code", "n")))).alias("votes"))  # a row for each language
    return out.select("track_id", F.col("w.language_code").alias("language"), (F.col("w.p") / F.col("w.n")).alias("probability"), "votes")


def srt_diagnostics(files: DataFrame) -> DataFrame:
    """AGG-2. (track_id, srt_text[, bytes]) -> bytes, blocks, last_end_ms, durations of the cues in order, median and p90 (ms).

    p90 is the nearest rank (9 n + 9) div 10 of the sorted durations. A track is bounded, so one row holds its durations.
    """
    size = F.col("bytes") if "bytes" in files.columns else F.octet_length("srt_text").cast("long")
    heads = files.select("track_id", size.alias("bytes"), F.size(srt_blocks(F.col("srt_text"))).alias("blocks"))
    cues = parse_srt(files)
    length = F.when(F.col("end_ms") > F.col("start_ms"), F.struct("block_no", (F.col("end_ms") - F.col("start_ms")).alias("ms")))
    per = cues.groupBy("track_id").agg(F.max("end_ms").alias("last_end_ms"), F.transform(F.sort_array(F.collect_list(length)), lambda x: x["ms"]).alias("durations"), F.count("issue").alias("issues"))
    ordered = F.sort_array(F.coalesce("durations", F.array().cast("array<bigint>")))
    n = F.size(ordered)
    median = F.when(n == 0, 0.0).otherwise((F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2)
    p90 = F.when(n == 0, 0).otherwise(F.try_element_at(ordered, F.floor((9 * n + 9) / 10).cast("int")))
    out = heads.join(per, "track_id", "left")
    return out.select("track_id", "bytes", "blocks", F.coalesce("last_end_ms", F.lit(0)).alias("last_end_ms"), F.coalesce("durations", F.array().cast("array<bigint>")).alias("durations"), median.alias("median_ms"), p90.alias("p90_ms"), F.coalesce("issues", F.lit(0)).alias("issues"))


def cue_diagnostics(cues: DataFrame) -> DataFrame:
    """AGG-2 without the list of durations: cues (track_id, start_ms, end_ms) -> cues, last_end_ms, median_ms and p90_ms of a track of any length.

    Whole milliseconds are counted before they move, and ranks are running sums of these counts, so neither a task nor
    a row holds the cues of a track.
    """
    lasting = cues.filter(F.col("end_ms") > F.col("start_ms")).groupBy("track_id", (F.col("end_ms") - F.col("start_ms")).alias("ms")).agg(F.count("*").alias("n"))
    totals = lasting.groupBy("track_id").agg(F.sum("n").alias("total"))
    ranked = lasting.withColumn("upto", F.sum("n").over(Window.partitionBy("track_id").orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(totals, "track_id")
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("ms")))
    n = F.col("total")
    picked = ranked.groupBy("track_id").agg(at(F.floor((n + 1) / 2)).alias("low"), at(F.floor(n / 2) + 1).alias("high"), at(F.floor((9 * n + 9) / 10)).alias("p90"))
    heads = cues.groupBy("track_id").agg(F.count("*").alias("cues"), F.max("end_ms").alias("last_end_ms"))
    out = heads.join(picked, "track_id", "left")
    return out.select("track_id", "cues", F.coalesce("last_end_ms", F.lit(0)).alias("last_end_ms"), F.coalesce((F.col("low") + F.col("high")) / 2, F.lit(0.0)).alias("median_ms"), F.coalesce("p90", F.lit(0)).alias("p90_ms"))


#: A line with an arrow; it begins where no other character of a line stands before.
ARROW_LINE = r"(?<![^\r\n])[^\r\n]*?-->[^\r\n]*"


def spoken_words(text_col: str) -> Column:
    """The words of three and more ASCII letters of the lines that are text.

    Blank lines and lines of digits hold no such word, so only lines with an arrow have to be taken out; the rest is one pass over the text.
    """
    said = F.lower(text_col)
    spoken = F.when(said.contains("-->"), F.regexp_replace(said, ARROW_LINE, "")).otherwise(said)
    return F.regexp_extract_all(spoken, F.lit("[a-z]{3,}"), F.lit(0))


def token_counts(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, token, n): the spoken words without stop words."""
    return df.select(key, F.explode(spoken_words(text_col)).alias("token")).filter(~F.col("token").isin(*STOP_WORDS)).groupBy(key, "token").agg(F.count("*").alias("n"))


#: A word and its repeats in a text of sorted words; possessive, so that many repeats need no stack.
SAME_WORDS = r"([a-z]+)(?: \1(?![a-z]))*+"


def numbered_tokens(text_col: str) -> Column:
    """The spoken words without stop words, each with the number of its occurrence: a set that stands for the counts."""
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.coalesce(spoken_words(text_col), F.array().cast("array<string>"))), " "), F.lit(SAME_WORDS), F.lit(0))
    word = lambda run: F.substring_index(run, " ", 1)
    times = lambda run: F.floor((F.length(run) + 1) / (F.length(word(run)) + 1)).cast("int")
    kept = F.filter(runs, lambda run: ~word(run).isin(*STOP_WORDS))
    return F.flatten(F.transform(kept, lambda run: F.transform(F.sequence(F.lit(1), times(run)), lambda k: F.concat(word(run), k.cast("string")))))


def similarity_of_counts(left: DataFrame, right: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, similarity): token F1 from the counts (keys, token, n) of both sides. Both without tokens: 1; one: 0."""
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(2)))
    tokens = both.groupBy(*keys, "token").agg(F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("side") == 2, F.col("n")).otherwise(0)).alias("y"))
    sums = tokens.groupBy(*keys).agg(F.sum(F.least("x", "y")).alias("overlap"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = F.col("x") + F.col("y")
    similarity = F.when(total.isNull(), 1.0).when((F.col("x") == 0) | (F.col("y") == 0), 0.0).otherwise(2 * F.col("overlap") / total)
    return pairs.select(*keys).distinct().join(sums, keys, "left").select(*keys, similarity.alias("similarity"))


def text_similarity(pairs: DataFrame, key: str = "pair_id", left: str = "left_text", right: str = "right_text") -> DataFrame:
    """AGG-3. (key, similarity) of pairs that hold their texts. A pair is compared in its own row, so a task holds the tokens of one pair at a time.

    Where rows share a key, their counts are added up: these tokens are shuffled by (key, token), so no such pair sits in one task.
    """
    tokens = pairs.select(key, numbered_tokens(left).alias("__x"), numbered_tokens(right).alias("__y"))
    own = tokens.select(key, F.size(F.array_intersect("__x", "__y")).alias("overlap"), F.size("__x").alias("x"), F.size("__y").alias("y"))
    rows = own.groupBy(key).agg(F.count("*").alias("n"), F.first("overlap").alias("overlap"), F.first("x").alias("x"), F.first("y").alias("y"))
    total = F.col("x") + F.col("y")
    similarity = F.when(F.col(key).isNull() | (total == 0), 1.0).when((F.col("x") == 0) | (F.col("y") == 0), 0.0).otherwise(2 * F.col("overlap") / total)
    single = rows.filter((F.col("n") == 1) | F.col(key).isNull()).select(key, similarity.alias("similarity"))
    shared = pairs.join(rows.filter("n > 1").select(key), key, "left_semi")
    return single.unionByName(similarity_of_counts(token_counts(shared, key, left), token_counts(shared, key, right), shared, [key]))


#: Counters of the sketch that line counts are summed up in, and how many rows of a line one task may get.
SKETCH, HOT_ROWS = 1 << 16, 100_000


def line_pairs(left: DataFrame, right: DataFrame, left_id: str = "left_id", right_id: str = "right_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(left_id, right_id) of texts that share a line that isn't blank, each pair once. No text moves: lines travel as hashes of 128 bits.

    A sketch of SKETCH counters, the sums of the counts of the lines that fall on each, says how frequent a line of the left side can be at most. Lines that may
    have more than hot_rows rows are salted: the left rows are dealt over as many sub-keys as they need, the right rows go to all of them.
    """

    def lines(df: DataFrame, key: str) -> DataFrame:
        parts = df.select(F.col(key).alias(key), F.explode(F.split(text, "\n")).alias("line")).filter(F.trim("line") != "")
        return parts.select(key, F.unhex(F.md5("line")).alias("line")).distinct().withColumn("counter", F.pmod(F.xxhash64("line"), F.lit(SKETCH)))

    a, b = lines(left, left_id), lines(right, right_id)
    hot = F.broadcast(a.groupBy("counter").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("counter", F.ceil(F.col("n") / hot_rows).cast("int").alias("salts")))  # SKETCH rows at most
    salts = F.coalesce("salts", F.lit(1))
    dealt = a.join(hot, "counter", "left").select(left_id, "line", F.pmod(F.xxhash64(F.col(left_id)), salts).cast("int").alias("salt"))
    copied = b.join(hot, "counter", "left").select(right_id, "line", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return dealt.join(copied, ["line", "salt"]).select(left_id, right_id).distinct()


def document_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str = "left_id", right_id: str = "right_id", text: str = "text") -> DataFrame:
    """AGG-3 on pairs of ids: (left_id, right_id, similarity). The tokens of a text are counted once, however many pairs it is in, and texts never move with the pairs."""
    counted = lambda df, key: pairs.join(token_counts(df.join(pairs.select(key).distinct(), key, "left_semi"), key, text), key).select(left_id, right_id, "token", "n")
    return similarity_of_counts(counted(left, left_id), counted(right, right_id), pairs, [left_id, right_id])


def stage_totals(manifest: DataFrame, cached: DataFrame, version: str, readable: bool = True) -> DataFrame:
    """AGG-4. Per stage, and as a row without a stage over all: required and missing URLs and bytes, status, reason.

    One rollup makes both; a missing byte count is 0. readable=False: the cache could not be read.
    """
    rows = with_cached(manifest, cached, version)
    size = F.coalesce("bytes", F.lit(0))
    lacking = ~F.col("cached")
    out = rows.rollup("stage").agg(F.count("*").alias("required"), F.count_if(lacking).alias("missing"), F.sum(size).alias("required_bytes"), F.sum(F.when(lacking, size).otherwise(0)).alias("missing_bytes"), F.grouping("stage").alias("total"))
    status = F.lit("unavailable") if not readable else F.when(F.col("missing") == 0, "offline-ready").otherwise("bootstrap-required")
    reason = F.when((F.col("total") == 0) & (status != "offline-ready"), F.concat(F.lit("Model assets are not cached for "), "stage", F.lit("; Python fallback remains required until bootstrap completes.")))
    return out.select(F.when(F.col("total") == 0, F.col("stage")).alias("stage"), "required", "missing", "required_bytes", "missing_bytes", status.alias("status"), reason.alias("reason"))


def asset_report(manifest: DataFrame, cached: DataFrame, version: str, readable: bool = True) -> DataFrame:
    """AGG-4 with the lists of required and missing URLs of each stage."""
    rows = with_cached(manifest, cached, version)
    urls = rows.groupBy("stage").agg(F.sort_array(F.collect_list("versioned_url")).alias("required_urls"), F.sort_array(F.collect_list(F.when(~F.col("cached"), F.col("versioned_url")))).alias("missing_urls"))
    return stage_totals(manifest, cached, version, readable).join(urls, "stage", "left")


def bootstrap_steps(manifest: DataFrame, cached: DataFrame, version: str) -> DataFrame:
    """AGG-5, the steps."""
    rows = with_cached(manifest, cached, version)
    return rows.select("stage", F.coalesce(F.nullif("name", F.lit("")), "url").alias("asset_name"), "versioned_url", F.when(F.col("cached"), "cached").otherwise("pending-download").alias("status"), (~F.col("cached")).alias("retryable"), F.coalesce("bytes", F.lit(0)).alias("weight_bytes"))


def bootstrap_summary(manifest: DataFrame, cached: DataFrame, version: str) -> DataFrame:
    """AGG-5, the summary: one row."""
    steps = bootstrap_steps(manifest, cached, version)
    left = F.col("retryable")
    return steps.agg(
        F.count("*").alias("total_assets"), F.count_if(~left).alias("cached_assets"), F.count_if(left).alias("remaining_assets"), F.coalesce(F.sum("weight_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(left, F.col("weight_bytes")).otherwise(0)), F.lit(0)).alias("remaining_bytes"), F.array_join(F.sort_array(F.collect_set(F.when(left, F.col("stage")))), ",").alias("remaining_stages"),
    ).withColumn("status", F.when(F.col("remaining_assets") == 0, "offline-ready").otherwise("bootstrap-required"))


def endpoints_of(stage: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in ENDPOINTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[stage], F.array().cast("array<string>"))


def stage_report(results: DataFrame) -> DataFrame:
    """AGG-6, the rows in stage order: label, status and fallback endpoints of (run_id, stage, runtime, strategy, reason)."""
    browser = F.col("runtime") == "browser"
    out = results.filter(F.col("stage").isin(*STAGES)).select(
        "run_id", "stage", mapped(F.col("stage"), STAGE_LABELS).alias("label"), "runtime", "strategy", F.when(browser, "completed").otherwise("completed-via-fallback").alias("status"),
        F.when(browser, F.array().cast("array<string>")).otherwise(endpoints_of(F.col("stage"))).alias("endpoints"), "reason", stage_rank("stage").alias("ord"),
    )
    return out


def run_summary(results: DataFrame) -> DataFrame:
    """AGG-6. Per run: mode, number of stages, the fallback stages in order with endpoints and reason, and a line of text."""
    rows = stage_report(results)
    entry = F.struct("ord", "stage", "runtime", "strategy", "endpoints", "reason")
    runs = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(entry)).alias("s"))  # five stages
    back = F.filter("s", lambda x: x["runtime"] != "browser")
    line = F.transform("s", lambda x: F.concat(x["stage"], F.lit("="), F.when(x["runtime"] == "browser", "completed").otherwise("completed-via-fallback")))
    detail = F.transform(back, lambda x: F.concat(x["stage"], F.lit(" via "), F.array_join(x["endpoints"], ", "), F.when(F.length(x["reason"]) > 0, F.concat(F.lit(" ("), x["reason"], F.lit(")"))).otherwise("")))
    return runs.select("run_id", F.when(F.size(back) == 0, "client-side").otherwise("hybrid-fallback").alias("mode"), F.size("s").alias("stages"), F.size(back).alias("fallbacks"), F.array_join(detail, "; ").alias("fallback_stages"), F.array_join(line, "; ").alias("summary"))


def offline_availability(results: DataFrame) -> DataFrame:
    """AGG-7. Per run: stages that need the backend, an online service, or neither; and the class of processing."""
    backend = (F.col("runtime") != "browser") | (F.col("strategy") == "unavailable")
    online = ~backend & (F.col("strategy") == "cloud-provider")
    ranked = results.filter(F.col("stage").isin(*STAGES)).withColumn("e", F.struct(stage_rank("stage").alias("ord"), "stage"))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.col("e")))), lambda x: x["stage"]), ",")
    out = ranked.groupBy("run_id").agg(listed(backend).alias("backend_stages"), listed(online).alias("online_stages"), listed(~backend & ~online).alias("offline_stages"))
    kind = F.when(F.col("backend_stages") == "", F.when(F.col("online_stages") != "", "browser-with-online-service").otherwise("browser-only")).when(
        (F.col("offline_stages") != "") | (F.col("online_stages") != ""), "partial-browser-with-python-fallback"
    )
    return out.withColumn("processing", kind.otherwise("backend-required"))


def apply_readiness(capabilities: DataFrame, report: DataFrame) -> DataFrame:
    """AGG-7. Stages (run_id, stage, runtime, strategy) whose assets aren't ready fall back, with the reason of the asset report."""
    rows = report.filter("stage IS NOT NULL AND status <> 'offline-ready'").select("stage", F.col("status").alias("bootstrap_status"), F.col("reason").alias("bootstrap_reason"), "missing_bytes")
    out = capabilities.join(rows, "stage", "left")
    moved = F.col("bootstrap_status").isNotNull() & (F.col("strategy") != "unavailable")
    return out.select("run_id", "stage", F.when(moved, "server-fallback").otherwise(F.col("runtime")).alias("runtime"), "strategy", F.when(moved, F.col("bootstrap_reason")).alias("reason"), F.when(moved, F.col("bootstrap_status")).alias("bootstrap_status"), F.when(moved, F.col("missing_bytes")).otherwise(0).alias("remaining_bytes"))


def joined_failures(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def structure_issues(files: DataFrame) -> DataFrame:
    """AGG-8, the form of (track_id, srt_text): not empty, an arrow, a line that is 1, and text in a cue."""
    lines = F.transform(F.split("srt_text", "\r?\n"), lambda x: clean_text(x))
    shown = F.exists(lines, lambda x: (x != "") & ~x.rlike("^[0-9]+$") & ~x.contains("-->"))
    checks = joined_failures(
        F.when(clean_text(F.coalesce("srt_text", F.lit(""))) == "", "empty file"), F.when(~F.col("srt_text").contains("-->"), "no time line"), F.when(~F.array_contains(lines, "1"), "no first index"), F.when(~shown, "no cue text")
    )
    return files.select("track_id", checks.alias("failures"))


def check_srt(diagnostics: DataFrame, tracks: DataFrame, segments: DataFrame, coverage: float = COVERAGE, min_blocks: int | None = None, min_bytes: int | None = None, min_segments: int | None = None) -> DataFrame:
    """AGG-8. Failures per track: blocks, bytes, segments, and how far segments and cues reach; segments: (track_id, end)."""
    per = segments.groupBy("track_id").agg(F.count("*").alias("segments"), F.max("end").alias("segment_end"))
    rows = diagnostics.join(tracks.select("track_id", "duration_s"), "track_id").join(per, "track_id", "left").na.fill(0, ["segments", "segment_end"])
    d = F.col("duration_s")
    floor16 = F.greatest(F.lit(1), F.floor(d / 16))
    blocks, size, n = (F.lit(given) if given else rule for given, rule in ((min_blocks, floor16), (min_bytes, F.greatest(F.lit(1000), F.floor(d * 12))), (min_segments, floor16)))
    share = lambda x: F.when(d > 0, x / d).otherwise(0.0)
    checks = joined_failures(
        F.when(F.col("blocks") < blocks, "blocks"), F.when(F.col("bytes") < size, "bytes"), F.when(F.col("segments") < n, "segments"),
        F.when(share(F.col("segment_end")) < coverage, "segment coverage"), F.when(share(F.col("last_end_ms") / 1000) < coverage, "cue coverage"),
    )
    return rows.select("track_id", "blocks", "bytes", "segments", checks.alias("failures"))


def compare_srt(left: DataFrame, right: DataFrame, similarity: DataFrame, real_models: bool = False) -> DataFrame:
    """AGG-9. Two diagnostics (AGG-2) and a similarity (AGG-3, keyed by track_id): deltas, ratios, warnings and failures per track."""
    a = left.select("track_id", F.col("blocks").alias("a_blocks"), F.col("last_end_ms").alias("a_end"), F.col("median_ms").alias("a_median"))
    b = right.select("track_id", F.col("blocks").alias("b_blocks"), F.col("last_end_ms").alias("b_end"), F.col("median_ms").alias("b_median"))
    ratio = lambda x, y: F.when(F.col(y) != 0, F.col(x) / F.col(y)).otherwise(0.0)
    rows = a.join(b, "track_id").join(similarity, "track_id").select(
        "track_id", F.abs(F.col("a_blocks") - F.col("b_blocks")).alias("block_delta"), F.abs(F.col("a_end") - F.col("b_end")).alias("end_delta_ms"), "similarity", ratio("a_blocks", "b_blocks").alias("block_ratio"), ratio("a_median", "b_median").alias("median_ratio")
    )
    warnings = joined_failures(F.when(F.col("block_ratio") >= 2.5, "block ratio"), F.when((F.col("median_ratio") > 0) & (F.col("median_ratio") <= 0.5), "median cue ratio"))
    failures = joined_failures(
        F.when((F.col("block_delta") > MAX_BLOCK_DELTA) & ~F.lit(real_models), "block delta"), F.when(F.col("end_delta_ms") > MAX_END_DELTA_MS, "end delta"), F.when(F.col("similarity") < MIN_SIMILARITY, "similarity")
    )
    return rows.withColumn("warnings", warnings).withColumn("failures", failures)


def manifest_issues(manifests: DataFrame) -> DataFrame:
    """FUN-9. (manifest_id, issue) of manifests (manifest_id, version, has_timeouts, models): models an array of structs
    (key, stage, provider, strategy, model_id, assets: array of (url, bytes, sha256))."""
    models = F.coalesce("models", F.array().cast(dict(manifests.dtypes)["models"]))
    has = lambda stage: F.exists(models, lambda m: m["key"] == stage)
    own = manifests.select("manifest_id", F.explode(joined_failures(
        F.when(first_text("version") == "", "version is required"), F.when(~F.coalesce("has_timeouts", F.lit(False)), "timeouts are required"),
        F.when(~has("transcription"), "models.transcription is required"), F.when(~has("translation"), "models.translation is required"),
    )).alias("issue"))
    rows = manifests.select("manifest_id", F.explode(models).alias("m")).select("manifest_id", "m.*")
    at = lambda what: F.concat(F.lit("models."), F.col("key"), F.lit(what))
    per_model = rows.select("manifest_id", F.explode(joined_failures(
        F.when(~F.col("stage").eqNullSafe(F.col("key")), at(".stage must be its key")), F.when(first_text("provider") == "", at(".provider is required")), F.when(first_text("strategy") == "", at(".strategy is required")),
        F.when(first_text("model_id") == "", at(".modelId is required")), F.when(F.coalesce(F.size("assets"), F.lit(0)) <= 0, at(".assets must list an asset")),
    )).alias("issue"))
    assets = rows.select("manifest_id", "key", F.posexplode("assets").alias("n", "a"))
    of = lambda what: F.concat(F.lit("models."), F.col("key"), F.lit(".assets["), F.col("n").cast("string"), F.lit("]"), F.lit(what))
    url = F.col("a.url")
    per_asset = assets.select("manifest_id", F.explode(joined_failures(
        F.when(F.coalesce(url, F.lit("")) == "", of(".url is required")).when(url.rlike("^https?://") | url.startswith("//"), of(".url must be relative")),
        F.when(F.coalesce(F.col("a.sha256"), F.lit("")) == "", of(".sha256 is required")), F.when(~F.coalesce(F.col("a.bytes") > 0, F.lit(False)), of(".bytes must be positive")),
    )).alias("issue"))
    return own.unionByName(per_model).unionByName(per_asset)


def checksum_ok(expected: str, actual: str) -> Column:
    """FUN-9. A checksum that is 64 hex digits and equal regardless of case."""
    return F.col(expected).rlike(r"^[a-fA-F0-9]{64}$") & (F.lower(expected) == F.lower(actual))
