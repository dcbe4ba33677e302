"""The registered queries, one or more for each operator, with the SQL that gives the same rows.

Results are scalar columns: lists go out as joined text, times as whole milliseconds or microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, filters as L, joins as J, segments as G, windows as W
from ..operators.model_batches import map_model
from ..sources import assets as AS, files as FS, payloads as P, subtitles as T
from ..streaming import live
from .feeds import by_time, fed, in_parts, shared_folder
from .views import JOB_EVENT, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


def us(c: str) -> Column:
    return F.round(F.col(c) * 1_000_000).cast("long").alias(f"{c}_us")


def ms(c: str) -> Column:
    return F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")


def segments(v) -> DataFrame:
    return v("v_segments").select("track_id", F.col("idx").alias("index"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")


def silences(v) -> DataFrame:
    return v("v_silences").select("track_id", "k", (F.col("start_us") / 1_000_000).alias("silence_start"), (F.col("end_us") / 1_000_000).alias("silence_end"))


def frames(v) -> DataFrame:
    return v("v_timed").select("track_id", (F.col("t_us") / 1_000_000).alias("t"), (-F.col("value")).alias("level_db"))


# --- pieces of SQL that several oracles share -------------------------------------------------

SPLIT = """pieces AS (SELECT *, greatest(0, CAST(ceil((end_us - start_us) / 12000000.0) AS BIGINT) - 1) AS n FROM {src}),
 cut AS (SELECT * FROM (SELECT * EXCLUDE (start_us, end_us, n, k), start_us + k * 12000000 AS low, CASE WHEN k = n THEN end_us ELSE start_us + (k + 1) * 12000000 END AS high, k = n AS last FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM pieces)) WHERE NOT last OR high - low >= 400000)"""
SPEECH = """inner_ AS (SELECT track_id, coalesce(max(end_us) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_us, start_us AS end_us FROM {v_silences}),
 tail AS (SELECT t.track_id, coalesce(max(s.end_us), 0) AS start_us, 720000000 AS end_us FROM {v_tracks} t LEFT JOIN {v_silences} s ON t.track_id = s.track_id GROUP BY 1),
 voiced AS (SELECT * FROM (SELECT * FROM inner_ UNION ALL SELECT * FROM tail) x WHERE end_us - start_us >= 400000),
 speech AS (SELECT * FROM voiced UNION ALL SELECT track_id, 0, 720000000 FROM {v_tracks} WHERE track_id NOT IN (SELECT track_id FROM voiced))"""
TIME = "lpad(CAST({x} // 3600000 AS STRING), CAST(greatest(2, length(CAST({x} // 3600000 AS STRING))) AS INTEGER), '0') || ':' || lpad(CAST({x} // 60000 % 60 AS STRING), 2, '0') || ':' || lpad(CAST({x} // 1000 % 60 AS STRING), 2, '0') || ',' || lpad(CAST({x} % 1000 AS STRING), 3, '0')"
BLOCK = f"idx || chr(10) || {TIME.replace('{x}', 'start_ms')} || ' --> ' || {TIME.replace('{x}', 'end_ms')} || chr(10) || {{text}}"


def time_sql(x: str) -> str:
    return TIME.replace("{x}", f"({x})")


# --- sources and sinks ------------------------------------------------------------------------

@query("src1_media_catalogue", """SELECT file_name, CASE WHEN NOT (lower(file_name) LIKE '%.mp4' OR lower(file_name) LIKE '%.wav') THEN 'unsupported extension'
    WHEN duration_s IS NULL OR duration_s <= 0 THEN 'unreadable duration' WHEN duration_s > 9000 THEN 'over duration limit' END AS reject_reason FROM {v_media}""")
def _(v):
    return P.media_catalogue(v("v_media")).select("file_name", "reject_reason")


def payloads(v) -> DataFrame:
    """Segment payloads of tracks; every seventh track has an element that ends before it starts, every eleventh is empty."""
    s = v("v_segments")
    bad = (F.col("track_id").cast("int") % 7 == 0) & (F.col("idx") == 2)
    item = F.struct("idx", F.to_json(F.struct(F.col("idx").alias("index"), (F.col("start_ms") / 1000).alias("start"), F.when(bad, 0.0).otherwise(F.col("end_ms") / 1000).alias("end"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("text"))).alias("j"))
    rows = s.groupBy("track_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["j"]), ","), F.lit("]"))
    return rows.select("track_id", F.when(F.col("track_id").cast("int") % 11 == 0, "[]").otherwise(listed).alias("payload"))


VERDICT = """verdict AS (SELECT track_id, CASE WHEN CAST(track_id AS INT) % 11 = 0 THEN 'At least one segment is required.' WHEN CAST(track_id AS INT) % 7 = 0 AND max(idx) >= 2 THEN 'Segment end must be after its start.' END AS reason FROM {v_segments} GROUP BY track_id)"""


@query("src2_read_segments", "WITH " + VERDICT + """ SELECT s.track_id, idx AS index, start_ms, end_ms, reason FROM {v_segments} s JOIN verdict USING (track_id) WHERE reason IS NULL
    UNION ALL SELECT track_id, NULL, NULL, NULL, reason FROM verdict WHERE reason IS NOT NULL""")
def _(v):
    return P.read_segments(payloads(v)).select("track_id", F.col("index").cast("int").alias("index"), ms("start"), ms("end"), "reason")


@query("src3_read_text_segments", "WITH " + VERDICT + r""" SELECT s.track_id, idx AS index, start_ms, end_ms, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, reason FROM {v_segments} s JOIN verdict USING (track_id) WHERE reason IS NULL
    UNION ALL SELECT track_id, NULL, NULL, NULL, NULL, reason FROM verdict WHERE reason IS NOT NULL""")
def _(v):
    return P.read_text_segments(payloads(v)).select("track_id", F.col("index").cast("int").alias("index"), ms("start"), ms("end"), "text", "reason")


CUE_TEXT = r"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+') AND NOT contains(x, '-->')), chr(10))"


@query("src4_parse_srt", f"SELECT track_id, idx AS block_no, start_ms, end_ms, {CUE_TEXT} AS text, CASE WHEN {CUE_TEXT} = '' THEN 'no subtitle text' END AS issue FROM {{v_segments}}")
def _(v):
    return P.parse_srt(T.compose_srt(segments(v)))


@query("snk1_compose_srt", "WITH " + SPLIT.replace("{src}", "(SELECT track_id, idx, start_ms * 1000 AS start_us, end_ms * 1000 AS end_us, text FROM {v_segments})") + ", ms_ AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY low) AS idx, low, (low + 500) // 1000 AS start_ms, (high + 500) // 1000 AS end_ms, text FROM cut)"
    + f" SELECT track_id, string_agg({BLOCK.replace('{text}', 'text')}, chr(10) || chr(10) ORDER BY idx) || chr(10) AS srt_text FROM ms_ GROUP BY track_id")
def _(v):
    """The entry query: long segments are cut, numbered anew and composed."""
    return T.compose_srt(G.split_long(segments(v)).drop("index").withColumn("index", F.lit(None).cast("int")))


@query("snk2_subtitle_file_name", r"""SELECT doc_id, CASE WHEN b = '' THEN 'subtitles' ELSE b END || '.fr.srt' AS file_name, regexp_replace(file_name, '\.[^.]+$', '') || '.fr-en.srt' AS pair_name
    FROM (SELECT doc_id, file_name, substr(regexp_replace(regexp_replace(file_name, '\.[^.]+$', ''), '[^A-Za-z0-9_-]+', '_', 'g'), 1, 20) AS b FROM {v_media}) x""")
def _(v):
    return v("v_media").select("doc_id", S.subtitle_file_name("file_name", F.lit("fr")).alias("file_name"), S.pair_file_name("file_name", F.lit("fr"), F.lit("en")).alias("pair_name"))


MANIFESTS = """rows_ AS (SELECT p_partkey // 1000 AS m, p_partkey, p_brand AS stage, p_name AS name, CASE WHEN p_partkey % 29 = 0 THEN ' ' ELSE 'models/' || CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 2 ELSE p_partkey END END AS url, CAST(p_size AS BIGINT) AS bytes, p_partkey % 19 <> 0 AS required FROM {part})"""


@query("src5_required_assets", "WITH " + MANIFESTS + """ SELECT 'manifest-' || m AS source_manifest, stage, name, url, bytes FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY m, p_partkey) AS n FROM rows_ WHERE required AND trim(url) <> '') x WHERE n = 1
    UNION ALL SELECT DISTINCT 'manifest-' || m, 'manifest', 'manifest', 'manifest-' || m, NULL FROM rows_""")
def _(v):
    p = v("part")
    url = F.when(F.col("p_partkey") % 29 == 0, " ").otherwise(F.concat(F.lit("models/"), F.expr("IF(p_partkey % 2 = 0, p_partkey div 2, p_partkey)")))
    asset = F.struct(F.col("p_partkey").alias("ord"), F.struct(F.col("p_brand").alias("stage"), F.col("p_name").alias("name"), url.alias("url"), F.col("p_size").cast("bigint").alias("bytes"), F.md5(F.col("p_name").cast("binary")).alias("sha256"), (F.col("p_partkey") % 19 != 0).alias("required")).alias("a"))
    m = p.groupBy(F.expr("p_partkey div 1000").alias("manifest_order")).agg(F.transform(F.sort_array(F.collect_list(asset)), lambda x: x["a"]).alias("assets"))
    return AS.required_assets(m.withColumn("source_manifest", F.concat(F.lit("manifest-"), "manifest_order"))).select("source_manifest", "stage", "name", "url", "bytes")


SRT_OF = f"SELECT track_id, string_agg({BLOCK.replace('{text}', 'text')}, chr(10) || chr(10) ORDER BY idx) || chr(10) AS srt FROM {{v_segments}} GROUP BY track_id"


def subtitle_tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the subtitles of every conversation, a file each."""
    documents = T.compose_srt(segments(lambda n: view(spark, sf_dir, n)))
    path = shared_folder(spark, "subtitles")
    FS.write_srt(documents.select(F.concat("track_id", F.lit(".v1.srt")).alias("file_name"), "srt_text"), path)
    return path


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtitles written as files, and the inventory of their tree."""
    return FS.file_inventory(spark, subtitle_tree(spark, sf_dir))


def _expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(subtitle_tree(spark, sf_dir)).select("path", "length", "modificationTime")
    return AS.expired_artifacts(files, "2100-01-01 00:00:00", 7).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subtitles written as files, read again and parsed."""
    files = FS.read_srt(spark, subtitle_tree(spark, sf_dir))
    return P.parse_srt(files.withColumn("track_id", F.regexp_replace("track_id", r"\.v1$", "")))


QUERIES["src6_file_inventory"] = _inventory
ORACLES["src6_file_inventory"] = with_views(f"SELECT track_id || '.v1' AS name, track_id || '.v1.srt' AS url, octet_length(encode(srt)) AS bytes, sha256(srt) AS sha256, TRUE AS required FROM ({SRT_OF}) x")
QUERIES["src8_expired_artifacts"] = _expired
ORACLES["src8_expired_artifacts"] = with_views(f"SELECT track_id || '.v1.srt' AS name, octet_length(encode(srt)) AS length FROM ({SRT_OF}) x")
QUERIES["src4_srt_files"] = _round_trip
ORACLES["src4_srt_files"] = ORACLES["src4_parse_srt"]


@query("src6_inventory_of_table", "SELECT doc_id || '.v1' AS name, source || '/' || doc_id || '.v1.srt' AS url, octet_length(encode(text)) AS bytes, sha256(text) AS sha256, TRUE AS required FROM {documents}")
def _(v):
    """The documents as files of a listing."""
    path = F.concat(F.lit("file:///media/"), "source", F.lit("/"), "doc_id", F.lit(".v1.srt"))
    return AS.inventory_of(v("documents").select(path.alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content")), "file:///media")


@query("src8_expired_of_table", "SELECT 'runs/' || user_id || '/' || event_id || '.srt' AS path FROM {events} WHERE event_id % 3 <> 0 AND ts < TIMESTAMP '2024-01-13 12:00:00'")
def _(v):
    """The events as artifacts of a listing, a third of them of another kind."""
    kind = F.when(F.col("event_id") % 3 == 0, ".json").otherwise(".srt")
    files = v("events").select(F.concat(F.lit("runs/"), "user_id", F.lit("/"), "event_id", kind).alias("path"), F.col("ts").cast("timestamp").alias("modificationTime"))
    return AS.expired_artifacts(files, "2024-01-20 12:00:00", 7).select("path")


@query("src7_silences_from_log", r"""WITH m AS (SELECT track_id, line_no, regexp_extract(line, 'silence_(start|end): ([0-9.]+)', 1) AS kind, CAST(nullif(regexp_extract(line, 'silence_(start|end): ([0-9.]+)', 2), '') AS DOUBLE) AS t FROM {v_log}),
    p AS (SELECT *, lag(kind) OVER (PARTITION BY track_id ORDER BY line_no) AS b, lag(t) OVER (PARTITION BY track_id ORDER BY line_no) AS f FROM m WHERE kind <> '')
    SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY line_no) AS k, f AS silence_start, t AS silence_end FROM p WHERE kind = 'end' AND b = 'start'""")
def _(v):
    return P.silences_from_log(v("v_log"))


# --- predicates -------------------------------------------------------------------------------

IDS = "CASE doc_id % 5 WHEN 0 THEN md5(CAST(doc_id AS STRING)) WHEN 1 THEN upper(md5(CAST(doc_id AS STRING))) WHEN 2 THEN md5(CAST(doc_id AS STRING)) || chr(10) WHEN 3 THEN substr(md5(CAST(doc_id AS STRING)), 2) ELSE NULL END"


@query("fil1_valid_ids", f"SELECT doc_id, id FROM (SELECT doc_id, {IDS} AS id FROM {{documents}}) x WHERE length(id) = 32 AND translate(id, '0123456789abcdef', '') = ''")
def _(v):
    return L.valid_ids(v("documents").select("doc_id", F.expr(IDS.replace("chr(10)", "'\\n'")).alias("id")))


PAIRS = "closure AS (SELECT DISTINCT source, target FROM {v_direct} WHERE source <> target UNION SELECT a.source, b.target FROM {v_direct} a JOIN {v_direct} b ON a.target = 'n19' AND b.source = 'n19' WHERE a.source <> b.target AND a.source <> a.target AND b.source <> b.target)"


@query("fil2_language_request", "WITH " + PAIRS + """ SELECT o_orderkey, CASE WHEN r.source = r.target THEN 'Source and target languages must differ.' WHEN p.source IS NULL THEN 'Unsupported language pair.' END AS reason
    FROM {v_requests} r LEFT JOIN closure p ON r.source = p.source AND r.target = p.target""")
def _(v):
    return L.check_language_request(v("v_requests"), J.supported_pairs(v("v_direct"), "n19")).select("o_orderkey", "reason")


@query("fil3_route_by_limits", """SELECT doc_id, CASE WHEN reason IS NULL THEN 'browser' ELSE 'server-fallback' END AS runtime, reason FROM (SELECT doc_id, CASE
    WHEN stage = 'audioExtraction' AND size_bytes > 838860800 THEN 'file too large' WHEN stage = 'audioExtraction' AND duration_s > 3600 THEN 'duration over limit'
    WHEN stage = 'transcription' AND duration_s > 900 THEN 'duration over limit' WHEN stage = 'transcription' AND size_bytes > 262144000 THEN 'audio too large'
    WHEN stage IN ('transcription', 'translation') AND n_segments > 300 THEN 'too many segments' END AS reason FROM {v_media}) x""")
def _(v):
    return L.route_by_limits(v("v_media")).select("doc_id", "runtime", "reason")


@query("fil4_split_diagnostics", """SELECT track_id, position, index, start_ms, end_ms, diagnostics, reject FROM (SELECT track_id, idx - 1 AS position, CASE WHEN idx % 9 = 0 THEN NULL ELSE idx END AS index, start_ms, CASE WHEN idx % 5 = 0 THEN NULL ELSE end_ms END AS end_ms,
    'confidence=' || idx % 100 || ',note=n' || CAST(track_id AS INT) % 3 AS diagnostics, CASE WHEN idx % 5 = 0 THEN 'numeric start and end required' END AS reject FROM {v_segments}) x""")
def _(v):
    item = F.to_json(F.struct(F.when(F.col("idx") % 9 != 0, F.col("idx")).alias("index"), (F.col("start_ms") / 1000).alias("start"), F.when(F.col("idx") % 5 == 0, F.lit("x")).otherwise((F.col("end_ms") / 1000).cast("string")).alias("end"), "text", (F.col("idx") % 100).alias("confidence"), F.concat(F.lit("n"), F.col("track_id").cast("int") % 3).alias("note")))
    out = L.split_diagnostics(v("v_segments").select("track_id", (F.col("idx") - 1).alias("position"), item.alias("segment")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("diagnostics")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("track_id", "position", "index", ms("start"), ms("end"), shown.alias("diagnostics"), "reject")


@query("fil5_check_stage_results", """SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'invalid stage' WHEN event_id % 31 = 0 THEN 'invalid runtime' WHEN strategy = 'unavailable' THEN 'strategy required' WHEN event_id % 37 = 0 THEN 'payload must be an object'
    WHEN stage = 'audioExtraction' AND event_id % 2 = 0 THEN 'audio reference required' WHEN stage = 'srtFormatting' AND event_id % 4 = 0 THEN 'srt text required' END AS violation,
    CASE WHEN event_id % 23 <> 0 AND stage = 'audioExtraction' THEN CASE WHEN event_id % 37 <> 0 AND event_id % 2 = 1 OR event_id % 31 = 0 OR runtime <> 'browser' THEN 'server' ELSE 'none' END END AS storage FROM {v_stage_rows}""")
def _(v):
    e = F.col("event_id")
    payload = F.when(e % 37 == 0, "[1]").when((F.col("stage") == "audioExtraction") & (e % 2 == 1), '{"audioId":"a"}').when((F.col("stage") == "srtFormatting") & (e % 4 != 0), '{"srtText":""}').otherwise("{}")
    rows = v("v_stage_rows").select("event_id", F.when(e % 23 == 0, "mux").otherwise(F.col("stage")).alias("stage"), F.when(e % 31 == 0, "cloud").otherwise(F.col("runtime")).alias("runtime"), F.when(F.col("strategy") != "unavailable", F.col("strategy")).otherwise("").alias("strategy"), payload.alias("payload"), F.lit("{}").alias("metadata"))
    return L.check_stage_results(rows).select("event_id", "violation", "storage")


# --- segments ---------------------------------------------------------------------------------

@query("seg1_silences_from_frames", """WITH f AS (SELECT track_id, t_us, -value AS level, coalesce(lead(t_us) OVER w, t_us) AS until, lag(-value <= -35) OVER w AS b, -value <= -35 AS q FROM {v_timed} WINDOW w AS (PARTITION BY track_id ORDER BY t_us, -value)),
    g AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> q THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t_us, level) AS island FROM f),
    i AS (SELECT track_id, min(t_us) AS low, max(until) AS high FROM g WHERE q GROUP BY track_id, island HAVING max(until) - min(t_us) >= 450000)
    SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY low) AS k, low AS silence_start_us, high AS silence_end_us FROM i""")
def _(v):
    return G.silences_from_frames(frames(v)).select("track_id", "k", us("silence_start"), us("silence_end"))


@query("seg2_speech_from_silences", "WITH " + SPEECH + " SELECT track_id, start_us, end_us FROM speech")
def _(v):
    return G.speech_from_silences(silences(v), v("v_tracks")).select("track_id", us("start"), us("end"))


@query("seg3_split_long", "WITH " + SPLIT.replace("{src}", "(SELECT track_id, idx AS index, start_ms * 1000 AS start_us, end_ms * 1000 AS end_us FROM {v_segments})") + " SELECT track_id, index, low AS start_us, high AS end_us FROM cut")
def _(v):
    return G.split_long(segments(v)).select("track_id", "index", us("start"), us("end"))


@query("seg4_segment_tracks", "WITH " + SPEECH + ", " + SPLIT.replace("{src}", "speech") + """ SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY low, high) AS index, (low + 500) // 1000 AS start_ms, (high + 500) // 1000 AS end_ms,
    'Speech segment ' || row_number() OVER (PARTITION BY track_id ORDER BY low, high) AS text FROM cut""")
def _(v):
    return G.segment_tracks(silences(v), v("v_tracks")).select("track_id", "index", ms("start"), ms("end"), "text")


LASTING = "SELECT track_id, max(end_ms) * 1000 AS d FROM {v_segments} GROUP BY track_id"


def lasting(v) -> DataFrame:
    return v("v_segments").groupBy("track_id").agg((F.max("end_ms") / 1000).alias("duration_s"))


@query("seg5_fixed_segments", f"SELECT track_id, k + 1 AS index, k * 12000000 AS start_us, least(d, (k + 1) * 12000000) AS end_us FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(d / 12000000.0) AS BIGINT)))) AS k FROM ({LASTING}) t) x")
def _(v):
    return G.fixed_segments(lasting(v)).select("track_id", "index", us("start"), us("end"))


@query("seg6_sample_windows", f"""SELECT track_id, k + 1 AS sample_no, CASE WHEN room <= 0 THEN 0 ELSE CAST(round(room / 1000.0 * k / 4) AS BIGINT) END AS start_ms, least(30000000, d) // 1000 AS length_ms
    FROM (SELECT *, unnest(range(0, CASE WHEN room <= 0 THEN 1 ELSE 5 END)) AS k FROM (SELECT *, d - least(30000000, d) AS room FROM ({LASTING}) t) y) x""")
def _(v):
    return G.sample_windows(lasting(v)).select("track_id", "sample_no", ms("start"), ms("length"))


@query("seg7_normalise_time_unit", """SELECT l_orderkey, l_linenumber, CAST(round(CASE WHEN v <= 500 + 25.0 THEN v WHEN v / 1000 <= 525 THEN v / 1000 WHEN v / 16000 <= 525 THEN v / 16000 WHEN v = floor(v) AND v >= 1000 THEN v / 1000 ELSE v END * 1000000) AS BIGINT) AS t_us
    FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN floor(l_extendedprice) WHEN 2 THEN floor(l_extendedprice) * 100 ELSE l_extendedprice * 1000 END AS v FROM {lineitem}) x""")
def _(v):
    price = F.col("l_extendedprice")
    value = F.when(F.col("l_linenumber") % 4 == 0, F.col("l_quantity")).when(F.col("l_linenumber") % 4 == 1, F.floor(price).cast("double")).when(F.col("l_linenumber") % 4 == 2, F.floor(price) * 100.0).otherwise(price * 1000)
    return v("lineitem").select("l_orderkey", "l_linenumber", F.round(S.normalise_time_unit(value, F.lit(500.0), F.lit(16000)) * 1_000_000).cast("long").alias("t_us"))


@query("seg8_slice_samples", """SELECT s.track_id, s.idx AS index, count(c.ch) AS n, CAST(coalesce(sum(ascii(c.ch) % 7), 0) AS BIGINT) AS total FROM {v_segments} s LEFT JOIN (SELECT track_id, unnest(range(0, len(text))) AS n, unnest(list_transform(range(1, len(text) + 1), lambda i: substr(text, i, 1))) AS ch
    FROM (SELECT track_id, string_agg(text, '' ORDER BY idx) AS text FROM {v_segments} GROUP BY track_id) q) c ON s.track_id = c.track_id AND c.n >= floor(start_ms / 1000 * 25) AND c.n < ceil(end_ms / 1000 * 25) GROUP BY 1, 2""")
def _(v):
    """The characters of a track as its signal, 25 a second; each segment gets its own back."""
    whole = v("v_segments").groupBy("track_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "").alias("all"))
    signals = whole.select("track_id", F.lit(25).alias("rate"), F.transform(F.split("all", ""), lambda c: F.ascii(c) % 7).alias("pcm"))
    out = G.slice_samples(segments(v).select("track_id", "index", "start", "end"), signals)
    return out.select("track_id", "index", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("seg8_slice_long_samples", """SELECT s.track_id, s.k, count(*) AS n, sum(e.event_id) AS total FROM {v_silences} s JOIN {v_timed} e ON s.track_id = e.track_id AND e.t_us >= s.start_us AND e.t_us < s.end_us GROUP BY 1, 2""")
def _(v):
    samples = v("v_timed").select("track_id", F.col("t_us").alias("sample_no"), F.col("event_id").alias("value"))
    spans = silences(v).select("track_id", "k", F.col("silence_start").alias("start"), F.col("silence_end").alias("end"))
    return G.slice_long_samples(spans, samples, v("v_tracks").select("track_id", F.lit(1_000_000).alias("rate"))).groupBy("track_id", "k").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("seg9_review_segments", "SELECT track_id, count(*) AS n, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS speech_ms, CAST(round(sum(greatest(0, end_ms - start_ms)) / count(*)) AS BIGINT) AS avg_ms FROM {v_segments} GROUP BY track_id")
def _(v):
    s = segments(v)
    return G.review_segments(s, s.select("track_id")).select("track_id", "n", F.round(F.col("speech_s") * 1000).cast("long").alias("speech_ms"), F.round(F.col("avg_s") * 1000).cast("long").alias("avg_ms"))


# --- joins ------------------------------------------------------------------------------------

@query("joi1_attach_transcripts", "SELECT track_id, idx AS index, start_ms, end_ms, CASE WHEN idx % 3 = 0 THEN '' ELSE '<' || text || '>' END AS text FROM {v_segments}")
def _(v):
    said = v("v_segments").filter("idx % 3 <> 0").select("track_id", F.col("idx").alias("index"), F.concat(F.lit("<"), "text", F.lit(">")).alias("text"))
    own = segments(v).withColumn("index", F.when(F.col("index") % 4 == 0, 0).otherwise(F.col("index")))
    return J.attach_transcripts(own, said).select("track_id", "index", ms("start"), ms("end"), "text")


@query("joi2_attach_translations", "SELECT track_id, idx AS index, text, CASE WHEN idx % 3 = 0 THEN '' ELSE '2:' || text END AS translated_text FROM {v_segments}")
def _(v):
    rows = v("v_segments").filter("idx % 3 <> 0")
    twice = rows.select("track_id", F.col("idx").alias("index"), F.explode(F.array(F.lit(2), F.lit(1))).alias("seq"), "text").select("track_id", "index", "seq", F.concat("seq", F.lit(":"), "text").alias("translated_text"))
    return J.attach_translations(segments(v), twice).select("track_id", "index", "text", "translated_text")


@query("joi3_supported_pairs", "WITH " + PAIRS + " SELECT source, target FROM closure")
def _(v):
    return J.supported_pairs(v("v_direct"), "n19")


@query("joi4_resolve_routes", """SELECT o_orderkey, CASE WHEN d.source IS NOT NULL THEN 'direct' WHEN a.source IS NOT NULL AND b.target IS NOT NULL AND r.source <> 'n19' AND r.target <> 'n19' THEN 'pivot' ELSE 'none' END AS route,
    CASE WHEN d.source IS NOT NULL THEN r.source || '>' || r.target WHEN a.source IS NOT NULL AND b.target IS NOT NULL AND r.source <> 'n19' AND r.target <> 'n19' THEN r.source || '>n19>' || r.target ELSE '' END AS hops
    FROM {v_requests} r LEFT JOIN {v_direct} d ON r.source = d.source AND r.target = d.target LEFT JOIN {v_direct} a ON r.source = a.source AND a.target = 'n19' LEFT JOIN {v_direct} b ON r.target = b.target AND b.source = 'n19'""")
def _(v):
    return J.resolve_routes(v("v_requests"), v("v_direct"), "n19").select("o_orderkey", "route", F.array_join("hops", ">").alias("hops"))


@query("joi5_missing_assets", "SELECT stage, name, url || '?v=v1' AS versioned_url, bytes, sha256, TRUE AS retryable FROM {v_assets} WHERE required AND url || '?v=v1' NOT IN (SELECT url FROM {v_cached})")
def _(v):
    return J.missing_assets(v("v_assets"), v("v_cached"), "v1")


ISSUES = """m AS (SELECT p_partkey, stage, CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN 'https://x/' || p_partkey ELSE url END AS url, bytes, CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE sha256 END AS sha256 FROM {v_assets}),
    i AS (SELECT url, coalesce(bytes, 7) + CASE WHEN p_partkey % 43 = 0 THEN 1 ELSE 0 END AS b, CASE WHEN p_partkey % 47 = 0 THEN 'x' ELSE sha256 END AS s FROM {v_assets} WHERE p_partkey % 23 <> 0),
    j AS (SELECT m.*, i.b, i.s FROM m LEFT JOIN i ON m.url = i.url),
    found AS (SELECT stage AS source_manifest, p_partkey AS position, issue FROM (SELECT stage, p_partkey, unnest([
        CASE WHEN url = '' THEN 'url is required' WHEN url LIKE 'https://%' THEN 'remote asset URL' WHEN b IS NULL THEN 'packaged file is missing' END, CASE WHEN sha256 IS NULL THEN 'sha256 is required' END,
        CASE WHEN bytes IS NULL THEN 'bytes must be a positive integer' END, CASE WHEN b <> bytes THEN 'bytes mismatch' END, CASE WHEN s <> sha256 THEN 'sha256 mismatch' END]) AS issue FROM j) x WHERE issue IS NOT NULL)"""


def packaged(v) -> tuple[DataFrame, DataFrame]:
    """The parts as assets of a manifest for each brand, and an inventory that disagrees with some."""
    a, k = v("v_assets"), F.col("p_partkey")
    m = a.select(F.col("stage").alias("source_manifest"), k.alias("position"), F.when(k % 29 == 0, "").when(k % 31 == 0, F.concat(F.lit("https://x/"), k)).otherwise(F.col("url")).alias("url"), "bytes", F.when(k % 37 != 0, F.col("sha256")).alias("sha256"))
    return m, a.filter(k % 23 != 0).select("url", (F.coalesce("bytes", F.lit(7)) + (k % 43 == 0).cast("int")).alias("bytes"), F.when(k % 47 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))


@query("joi6_verify_assets", "WITH " + ISSUES + " SELECT source_manifest, position, issue FROM found")
def _(v):
    return J.verify_assets(*packaged(v))


@query("joi6_assets_verdicts", "WITH " + ISSUES + """, e AS (SELECT DISTINCT p_partkey // 20 AS pack FROM {part}), c AS (SELECT position // 20 AS pack, count(*) AS n FROM found WHERE position // 20 % 10 <> 7 GROUP BY 1), r AS (SELECT e.pack, coalesce(n, 0) AS n, e.pack % 10 = 7 AS absent FROM e LEFT JOIN c ON e.pack = c.pack)
    SELECT 'pack-' || pack AS source_manifest, n AS issues, CASE WHEN n > 0 OR absent THEN 'skip' ELSE 'ready' END AS verdict FROM r UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), CASE WHEN sum(n) > 0 OR bool_or(absent) THEN 'skip' ELSE 'ready' END FROM r""")
def _(v):
    """Twenty parts make a manifest; every tenth manifest is absent."""
    m, i = packaged(v)
    pack = F.expr("position div 20")
    expected = m.select(F.concat(F.lit("pack-"), pack).alias("source_manifest"))
    there = m.filter(pack % 10 != 7).withColumn("source_manifest", F.concat(F.lit("pack-"), pack))
    return J.assets_verdicts(expected, there, J.verify_assets(there, i))


@query("joi7_coalesce_runs", """WITH p AS (SELECT run_id, stage, runtime = 'browser' AS d, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'own' || event_id END AS own, CASE WHEN event_id % 7 = 0 THEN 'error ' || event_id END AS err, strategy FROM {v_stage_results} WHERE event_id % 13 <> 0),
    f AS (SELECT run_id, stage, 'other' || event_id AS other FROM {v_stage_results} WHERE event_id % 11 <> 0), b AS (SELECT coalesce(p.run_id, f.run_id) AS run_id, coalesce(p.stage, f.stage) AS stage, coalesce(d, FALSE) AS d, own, err, other, strategy FROM p FULL JOIN f ON p.run_id = f.run_id AND p.stage = f.stage)
    SELECT run_id, stage, CASE WHEN d AND own IS NOT NULL THEN own ELSE other END AS payload, CASE WHEN d AND own IS NOT NULL THEN 'browser' WHEN other IS NOT NULL THEN 'server-fallback' ELSE 'error' END AS runtime,
    CASE WHEN d AND own IS NULL THEN 'python-backend' ELSE coalesce(strategy, 'unavailable') END AS strategy, CASE WHEN d AND own IS NULL THEN coalesce(err, 'no result') END AS reason, CASE WHEN d AND own IS NULL AND strategy <> 'unavailable' THEN strategy END AS attempted_strategy FROM b""")
def _(v):
    r, e = v("v_stage_results"), F.col("event_id")
    own = r.filter(e % 13 != 0).select("run_id", "stage", (F.col("runtime") == "browser").alias("declared"), F.when(e % 7 != 0, F.concat(F.lit("own"), e)).alias("payload"), F.when(e % 7 == 0, F.concat(F.lit("error "), e)).alias("error"), "strategy")
    return J.coalesce_runs(own, r.filter(e % 11 != 0).select("run_id", "stage", F.concat(F.lit("other"), e).alias("payload")))


@query("joi8_language_names", """SELECT doc_id, lang AS code, c.name, CASE WHEN c.name IS NULL THEN 'unknown language' END AS reject, CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' ELSE lang END AS model_tag FROM {documents} d LEFT JOIN {v_catalogue} c ON d.lang = c.code""")
def _(v):
    return J.language_names(v("documents").select("doc_id", F.col("lang").alias("code")), v("v_catalogue"))


# --- aggregations -----------------------------------------------------------------------------

@query("agg1_vote_language", """WITH p AS (SELECT track_id, language_code, count(*) AS n, sum(probability) AS p, min(clip_no) AS f FROM {v_clips} WHERE trim(language_code) <> '' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, p DESC, f) AS k FROM p), m AS (SELECT track_id, string_agg(language_code || '=' || n, ',' ORDER BY language_code) AS votes FROM p GROUP BY 1)
    SELECT track_id, language_code AS language, CAST(round(p / n * 1000000) AS BIGINT) AS probability_ppm, votes FROM r JOIN m USING (track_id) WHERE k = 1""")
def _(v):
    out = A.vote_language(v("v_clips"))
    return out.select("track_id", "language", F.round(F.col("probability") * 1_000_000).cast("long").alias("probability_ppm"), F.array_join(F.transform(F.array_sort(F.map_entries("votes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("votes"))


def doc_srt(v, extra: int) -> DataFrame:
    """The segments as documents; extra > 0 leaves out every extra-th cue."""
    s = segments(v)
    return T.compose_srt(s.filter(F.col("index") % extra != 0) if extra else s)


DIAG = f"""SELECT track_id, octet_length(encode(srt)) AS bytes, blocks, last_end_ms, durations, median_ms, p90_ms FROM (SELECT track_id, string_agg({BLOCK.replace('{text}', 'text')}, chr(10) || chr(10) ORDER BY idx) || chr(10) AS srt, count(*) AS blocks, max(end_ms) AS last_end_ms,
    string_agg(CASE WHEN end_ms > start_ms THEN end_ms - start_ms END, ',' ORDER BY idx) AS durations, quantile_cont(end_ms - start_ms, 0.5) AS median_ms, list_sort(list(end_ms - start_ms))[(9 * count(*) + 9) // 10] AS p90_ms FROM {{src}} GROUP BY track_id) x"""


@query("agg2_srt_diagnostics", DIAG.replace("{src}", "{v_segments}"))
def _(v):
    d = A.srt_diagnostics(doc_srt(v, 0))
    return d.select("track_id", "bytes", F.col("blocks").cast("long").alias("blocks"), "last_end_ms", F.array_join("durations", ",").alias("durations"), "median_ms", "p90_ms")


@query("agg2_cue_diagnostics", """SELECT track_id, count(*) AS cues, max(end_ms) AS last_end_ms, quantile_cont(end_ms - start_ms, 0.5) AS median_ms, list_sort(list(end_ms - start_ms))[(9 * count(*) + 9) // 10] AS p90_ms
    FROM (SELECT l_returnflag || l_linestatus AS track_id, l_orderkey * 1000 AS start_ms, l_orderkey * 1000 + CAST(l_quantity AS BIGINT) * 100 + l_linenumber AS end_ms FROM {lineitem}) x GROUP BY track_id""")
def _(v):
    """The line items as cues of a few tracks, each of which holds a large part of all cues."""
    start = F.col("l_orderkey") * 1000
    return A.cue_diagnostics(v("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("track_id"), start.alias("start_ms"), (start + F.col("l_quantity").cast("bigint") * 100 + F.col("l_linenumber")).alias("end_ms")))


STOPS = ", ".join(f"'{w}'" for w in A.STOP_WORDS)


def counts_sql(src: str, key: str, text: str) -> str:
    return f"""SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(line, '[a-z]{{{{3,}}}}')) AS token FROM (SELECT {key}, regexp_replace(unnest(regexp_split_to_array(lower({text}), '\\r\\n|[\\n\\r]')), '^\\s+|\\s+$', '', 'g') AS line FROM {src}) l
    WHERE line <> '' AND NOT regexp_full_match(line, '[0-9]+') AND NOT contains(line, '-->')) t WHERE token NOT IN ({STOPS}) GROUP BY 1, 2""".replace("{{3,}}", "{3,}")


def similarity_sql(src: str, key: str, left: str, right: str) -> str:
    return f"""a AS ({counts_sql(src, key, left)}), b AS ({counts_sql(src, key, right)}), t AS (SELECT coalesce(a.{key}, b.{key}) AS {key}, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.{key} = b.{key} AND a.token = b.token),
    u AS (SELECT {key}, sum(least(x, y)) AS o, sum(x) AS x, sum(y) AS y FROM t GROUP BY 1), similar_ AS (SELECT s.{key}, CASE WHEN u.x IS NULL THEN 1 WHEN u.x = 0 OR u.y = 0 THEN 0 ELSE 2 * o / (u.x + u.y) END AS similarity FROM (SELECT DISTINCT {key} FROM {src}) s LEFT JOIN u ON s.{key} = u.{key})"""


@query("agg3_text_similarity", "WITH " + similarity_sql("{v_pairs}", "pair_id", "left_text", "right_text") + " SELECT pair_id, CAST(round(similarity * 1000000) AS BIGINT) AS similarity_ppm FROM similar_")
def _(v):
    return A.text_similarity(v("v_pairs")).select("pair_id", F.round(F.col("similarity") * 1_000_000).cast("long").alias("similarity_ppm"))


QUOTES = """pairs AS (SELECT DISTINCT doc_id, item_id FROM {v_doc_lines} d JOIN {v_item_lines} b ON d.line = b.line WHERE trim(d.line) <> ''),
    quotes AS (SELECT d.doc_id || '-' || b.item_id AS pair_id, d.text AS left_text, b.text AS right_text FROM pairs p JOIN {documents} d ON p.doc_id = d.doc_id JOIN {benchmark} b ON p.item_id = b.item_id)"""


@query("agg3_benchmark_quotes", "WITH " + QUOTES + ", " + similarity_sql("quotes", "pair_id", "left_text", "right_text") + " SELECT pair_id, CAST(round(similarity * 1000000) AS BIGINT) AS similarity_ppm FROM similar_")
def _(v):
    """Documents and the benchmark items that they share a line with."""
    documents, items = v("documents").select(F.col("doc_id").alias("left_id"), "text"), v("benchmark").select(F.col("item_id").alias("right_id"), "text")
    out = A.document_similarity(A.line_pairs(documents, items), documents, items)
    return out.select(F.concat_ws("-", "left_id", "right_id").alias("pair_id"), F.round(F.col("similarity") * 1_000_000).cast("long").alias("similarity_ppm"))


FLAGGED = "SELECT a.*, c.url IS NOT NULL AS cached FROM {v_assets} a LEFT JOIN {v_cached} c ON a.url || '?v=v1' = c.url WHERE required"


@query("agg4_asset_report", f"""SELECT stage, required, missing, required_bytes, missing_bytes, status, CASE WHEN stage IS NOT NULL AND status <> 'offline-ready' THEN 'Model assets are not cached for ' || stage || '; Python fallback remains required until bootstrap completes.' END AS reason
    FROM (SELECT stage, count(*) AS required, count(*) FILTER (NOT cached) AS missing, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS required_bytes, CAST(sum(CASE WHEN cached THEN 0 ELSE coalesce(bytes, 0) END) AS BIGINT) AS missing_bytes,
    CASE WHEN count(*) FILTER (NOT cached) = 0 THEN 'offline-ready' ELSE 'bootstrap-required' END AS status FROM ({FLAGGED}) f GROUP BY ROLLUP (stage)) x""")
def _(v):
    return A.stage_totals(v("v_assets"), v("v_cached"), "v1")


@query("agg4_asset_lists", f"SELECT stage, md5(string_agg(url || '?v=v1', ',' ORDER BY url || '?v=v1')) AS required_urls, coalesce(string_agg(CASE WHEN NOT cached THEN url || '?v=v1' END, ',' ORDER BY url || '?v=v1'), '') AS missing_urls FROM ({FLAGGED}) f GROUP BY stage")
def _(v):
    out = A.asset_report(v("v_assets"), v("v_cached"), "v1").filter("stage IS NOT NULL")
    return out.select("stage", F.md5(F.array_join("required_urls", ",").cast("binary")).alias("required_urls"), F.array_join("missing_urls", ",").alias("missing_urls"))


@query("agg5_bootstrap_steps", f"SELECT stage, name AS asset_name, url || '?v=v1' AS versioned_url, CASE WHEN cached THEN 'cached' ELSE 'pending-download' END AS status, NOT cached AS retryable, coalesce(bytes, 0) AS weight_bytes FROM ({FLAGGED}) f")
def _(v):
    return A.bootstrap_steps(v("v_assets"), v("v_cached"), "v1")


@query("agg5_bootstrap_summary", f"""SELECT count(*) AS total_assets, count(*) FILTER (cached) AS cached_assets, count(*) FILTER (NOT cached) AS remaining_assets, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN cached THEN 0 ELSE coalesce(bytes, 0) END) AS BIGINT) AS remaining_bytes,
    coalesce(string_agg(DISTINCT CASE WHEN NOT cached THEN stage END, ',' ORDER BY CASE WHEN NOT cached THEN stage END), '') AS remaining_stages, CASE WHEN count(*) FILTER (NOT cached) = 0 THEN 'offline-ready' ELSE 'bootstrap-required' END AS status FROM ({FLAGGED}) f""")
def _(v):
    return A.bootstrap_summary(v("v_assets"), v("v_cached"), "v1")


RANK = "CASE stage WHEN 'audioExtraction' THEN 0 WHEN 'vad' THEN 1 WHEN 'transcription' THEN 2 WHEN 'translation' THEN 3 ELSE 4 END"
ENDPOINT = "CASE stage " + " ".join(f"WHEN '{k}' THEN '{', '.join(e)}'" for k, e in A.ENDPOINTS.items()).replace("{jobId}", "' || chr(123) || 'jobId' || chr(125) || '") + " ELSE '' END"


@query("agg6_run_summary", f"""SELECT run_id, CASE WHEN count(*) FILTER (runtime <> 'browser') = 0 THEN 'client-side' ELSE 'hybrid-fallback' END AS mode, CAST(count(*) AS INT) AS stages, CAST(count(*) FILTER (runtime <> 'browser') AS INT) AS fallbacks,
    coalesce(string_agg(CASE WHEN runtime <> 'browser' THEN stage || ' via ' || {ENDPOINT} || CASE WHEN reason IS NOT NULL THEN ' (' || reason || ')' ELSE '' END END, '; ' ORDER BY {RANK}), '') AS fallback_stages,
    string_agg(stage || '=' || CASE WHEN runtime = 'browser' THEN 'completed' ELSE 'completed-via-fallback' END, '; ' ORDER BY {RANK}) AS summary FROM {{v_stage_results}} GROUP BY run_id""")
def _(v):
    return A.run_summary(v("v_stage_results"))


BACK = "(runtime <> 'browser' OR strategy = 'unavailable')"


@query("agg7_offline_availability", f"""SELECT *, CASE WHEN backend_stages = '' THEN CASE WHEN online_stages <> '' THEN 'browser-with-online-service' ELSE 'browser-only' END WHEN online_stages <> '' OR offline_stages <> '' THEN 'partial-browser-with-python-fallback' ELSE 'backend-required' END AS processing
    FROM (SELECT run_id, coalesce(string_agg(CASE WHEN {BACK} THEN stage END, ',' ORDER BY {RANK}), '') AS backend_stages, coalesce(string_agg(CASE WHEN NOT {BACK} AND strategy = 'cloud-provider' THEN stage END, ',' ORDER BY {RANK}), '') AS online_stages,
    coalesce(string_agg(CASE WHEN NOT {BACK} AND strategy <> 'cloud-provider' THEN stage END, ',' ORDER BY {RANK}), '') AS offline_stages FROM {{v_stage_results}} GROUP BY run_id) x""")
def _(v):
    return A.offline_availability(v("v_stage_results"))


@query("agg7_apply_readiness", f"""WITH r AS (SELECT CASE WHEN stage IN ('Brand#1', 'Brand#2') THEN 'vad' WHEN stage IN ('Brand#3', 'Brand#4') THEN 'transcription' ELSE 'translation' END AS stage, coalesce(bytes, 0) AS bytes, cached FROM ({FLAGGED}) f),
    s AS (SELECT stage, CAST(sum(CASE WHEN cached THEN 0 ELSE bytes END) AS BIGINT) AS b FROM r GROUP BY stage HAVING count(*) FILTER (NOT cached) > 0)
    SELECT run_id, q.stage, CASE WHEN s.stage IS NOT NULL AND strategy <> 'unavailable' THEN 'server-fallback' ELSE runtime END AS runtime, CASE WHEN s.stage IS NOT NULL AND strategy <> 'unavailable' THEN 'bootstrap-required' END AS bootstrap_status,
    CASE WHEN s.stage IS NOT NULL AND strategy <> 'unavailable' THEN b ELSE 0 END AS remaining_bytes FROM {{v_stage_results}} q LEFT JOIN s ON q.stage = s.stage""")
def _(v):
    stage = F.when(F.col("stage").isin("Brand#1", "Brand#2"), "vad").when(F.col("stage").isin("Brand#3", "Brand#4"), "transcription").otherwise("translation")
    report = A.stage_totals(v("v_assets").withColumn("stage", stage), v("v_cached"), "v1")
    return A.apply_readiness(v("v_stage_results"), report).select("run_id", "stage", "runtime", "bootstrap_status", "remaining_bytes")


@query("agg8_check_srt", f"""WITH d AS ({DIAG.replace('{src}', '{v_segments}')}), t AS (SELECT track_id, max(end_ms) / 1000 + CAST(track_id AS INT) % 40 AS dur FROM {{v_segments}} GROUP BY 1),
    s AS (SELECT track_id, count(*) FILTER (idx % 3 <> 0) AS n, max(CASE WHEN idx % 3 <> 0 THEN end_ms END) / 1000 AS e FROM {{v_segments}} GROUP BY 1)
    SELECT track_id, blocks, bytes, n AS segments, array_to_string(list_filter([CASE WHEN blocks < greatest(1, floor(dur / 16)) THEN 'blocks' END, CASE WHEN bytes < greatest(1000, floor(dur * 12)) THEN 'bytes' END, CASE WHEN n < greatest(1, floor(dur / 16)) THEN 'segments' END,
    CASE WHEN coalesce(e, 0) / dur < 0.85 THEN 'segment coverage' END, CASE WHEN last_end_ms / 1000 / dur < 0.85 THEN 'cue coverage' END], lambda x: x IS NOT NULL), ',') AS failures FROM d JOIN t USING (track_id) JOIN s USING (track_id)""")
def _(v):
    s = segments(v)
    tracks = s.groupBy("track_id").agg((F.max("end") + F.col("track_id").cast("int") % 40).alias("duration_s"))
    out = A.check_srt(A.srt_diagnostics(doc_srt(v, 0)), tracks, s.filter(F.col("index") % 3 != 0))
    return out.select("track_id", F.col("blocks").cast("long").alias("blocks"), "bytes", "segments", F.array_join("failures", ",").alias("failures"))


@query("agg8_structure_issues", r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_full_match(text, '\s*') THEN 'empty file' END, CASE WHEN NOT contains(text, '-->') THEN 'no time line' END, CASE WHEN NOT list_contains(l, '1') THEN 'no first index' END,
    CASE WHEN len(list_filter(l, lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+') AND NOT contains(x, '-->'))) = 0 THEN 'no cue text' END], lambda x: x IS NOT NULL), ',') AS failures
    FROM (SELECT doc_id, text, list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM {documents}) q""")
def _(v):
    out = A.structure_issues(v("documents").select(F.col("doc_id").alias("track_id"), F.col("text").alias("srt_text")))
    return out.select(F.col("track_id").alias("doc_id"), F.array_join("failures", ",").alias("failures"))


HALF = "(SELECT * FROM {v_segments} WHERE idx % 3 <> 0)"


@query("agg9_compare_srt", "WITH " + f"da AS ({DIAG.replace('{src}', '{v_segments}')}), db AS ({DIAG.replace('{src}', HALF)}), j AS (SELECT a.track_id, a.t AS lt, b.t AS rt FROM (SELECT track_id, string_agg(text, chr(10) ORDER BY idx) AS t FROM {{v_segments}} GROUP BY 1) a JOIN (SELECT track_id, string_agg(text, chr(10) ORDER BY idx) AS t FROM {HALF} h GROUP BY 1) b USING (track_id)), "
    + similarity_sql("j", "track_id", "lt", "rt") + """ SELECT track_id, block_delta, end_delta_ms, CAST(round(similarity * 1000000) AS BIGINT) AS similarity_ppm, CAST(round(block_ratio * 1000) AS BIGINT) AS block_ratio_m, CAST(round(median_ratio * 1000) AS BIGINT) AS median_ratio_m,
    array_to_string(list_filter([CASE WHEN block_ratio >= 2.5 THEN 'block ratio' END, CASE WHEN median_ratio > 0 AND median_ratio <= 0.5 THEN 'median cue ratio' END], lambda x: x IS NOT NULL), ',') AS warnings,
    array_to_string(list_filter([CASE WHEN block_delta > 2 THEN 'block delta' END, CASE WHEN end_delta_ms > 5000 THEN 'end delta' END, CASE WHEN similarity < 0.90 THEN 'similarity' END], lambda x: x IS NOT NULL), ',') AS failures
    FROM (SELECT track_id, abs(a.blocks - b.blocks) AS block_delta, abs(a.last_end_ms - b.last_end_ms) AS end_delta_ms, CASE WHEN b.blocks <> 0 THEN a.blocks / b.blocks ELSE 0 END AS block_ratio, CASE WHEN b.median_ms <> 0 THEN a.median_ms / b.median_ms ELSE 0 END AS median_ratio, similarity FROM da a JOIN db b USING (track_id) JOIN similar_ s USING (track_id)) x""")
def _(v):
    a, b = doc_srt(v, 0), doc_srt(v, 3)
    pairs = a.withColumnRenamed("srt_text", "l").join(b.withColumnRenamed("srt_text", "r"), "track_id")
    out = A.compare_srt(A.srt_diagnostics(a), A.srt_diagnostics(b), A.text_similarity(pairs, "track_id", "l", "r"))
    part = lambda c, n, name: F.round(F.col(c) * n).cast("long").alias(name)
    return out.select("track_id", F.col("block_delta").cast("long").alias("block_delta"), "end_delta_ms", part("similarity", 1_000_000, "similarity_ppm"), part("block_ratio", 1000, "block_ratio_m"), part("median_ratio", 1000, "median_ratio_m"), F.array_join("warnings", ",").alias("warnings"), F.array_join("failures", ",").alias("failures"))


# --- windows, orders, sets --------------------------------------------------------------------

@query("win1_batch_numbers", "SELECT track_id, idx AS index, CAST((row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1) // 3 AS INT) AS batch FROM {v_segments}")
def _(v):
    return W.batch_numbers(segments(v), 3).select("track_id", "index", "batch")


SNAPSHOTS = """st AS (SELECT *, last_value(CASE WHEN kind <> 'cancel' THEN status END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, last_value(CASE WHEN kind <> 'cancel' THEN progress END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {v_job_events}),
    fc AS (SELECT job_id, min(seq) AS f FROM st WHERE kind = 'cancel' AND before IS NOT NULL AND before NOT IN ('succeeded', 'failed', 'cancelled') GROUP BY 1),
    kept AS (SELECT st.job_id, seq, CASE WHEN kind = 'cancel' THEN 'cancelled' ELSE status END AS status, CASE WHEN kind = 'cancel' THEN 'cancelled' ELSE stage END AS stage, CASE WHEN kind = 'cancel' THEN reached ELSE progress END AS progress, ts FROM st LEFT JOIN fc ON st.job_id = fc.job_id WHERE (kind <> 'cancel' AND (f IS NULL OR seq < f)) OR seq = f),
    snap AS (SELECT job_id, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(stage, seq) AS stage, arg_max(progress, seq) AS progress, min(ts) AS created FROM kept GROUP BY 1)"""


@query("win2_job_snapshots", "WITH " + SNAPSHOTS + " SELECT job_id, seq, status, stage, progress FROM snap")
def _(v):
    return W.job_snapshots(v("v_job_events")).select("job_id", "seq", "status", "stage", "progress")


@query("srt1_list_jobs", "WITH " + SNAPSHOTS + " SELECT job_id, status FROM snap ORDER BY created DESC, job_id")
def _(v):
    snapshots = W.job_snapshots(v("v_job_events").withColumn("ts", F.col("ts").cast("timestamp")))
    return W.list_jobs(snapshots).select("job_id", "status")


@query("srt2_stage_sort", f"SELECT run_id, stage, CAST({RANK} AS INT) AS rank FROM {{v_stage_results}} ORDER BY rank, run_id")
def _(v):
    return W.stage_sort(v("v_stage_results"), W.STAGES, "run_id").select("run_id", "stage", W.stage_rank("stage").alias("rank"))


@query("set1_language_backlog", """WITH counted AS (SELECT lang AS code, count(*) AS n FROM {documents} GROUP BY 1), cat AS (SELECT code FROM counted UNION ALL SELECT 'xx' UNION ALL SELECT 'yy'),
    missing AS (SELECT code, CAST(row_number() OVER (ORDER BY n DESC, code) AS INT) + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS priority, CASE WHEN n % 3 = 0 THEN 'other' ELSE 'translate-en_' || code END AS package FROM counted WHERE code <> 'en' UNION ALL SELECT 'zz', 9, 'translate-en_zz'),
    avail AS (SELECT code, TRUE AS prepared, n % 2 = 1 AS validated FROM counted UNION ALL SELECT 'yy', TRUE, FALSE), listed AS (SELECT code FROM avail WHERE validated UNION SELECT code FROM missing), targets AS (SELECT code FROM cat WHERE code <> 'en')
    SELECT 'not covered' AS issue, code FROM targets WHERE code NOT IN (SELECT code FROM listed) UNION ALL SELECT 'not in catalogue', code FROM listed WHERE code NOT IN (SELECT code FROM targets)
    UNION ALL SELECT 'validated and missing', code FROM avail WHERE validated AND code IN (SELECT code FROM missing) UNION ALL SELECT 'prepared but not in backlog', code FROM avail WHERE prepared AND NOT validated AND code NOT IN (SELECT code FROM missing)
    UNION ALL SELECT 'priority gap', code FROM (SELECT *, row_number() OVER (ORDER BY priority, code) AS k FROM missing) m WHERE priority <> k UNION ALL SELECT 'unexpected package', code FROM missing WHERE package <> 'translate-en_' || code""")
def _(v):
    counted = v("documents").groupBy(F.col("lang").alias("code")).agg(F.count("*").alias("n"))
    spark = counted.sparkSession
    order = W.Window.orderBy(F.col("n").desc(), "code")
    missing = counted.filter("code <> 'en'").select("code", (F.row_number().over(order) + F.when(F.col("n") % 2 == 0, 1).otherwise(0)).cast("int").alias("priority"), F.when(F.col("n") % 3 == 0, "other").otherwise(F.concat(F.lit("translate-en_"), "code")).alias("package"))
    missing = missing.union(spark.sql("SELECT 'zz', 9, 'translate-en_zz'"))
    available = counted.select("code", F.lit(True).alias("prepared"), (F.col("n") % 2 == 1).alias("validated")).union(spark.sql("SELECT 'yy', TRUE, FALSE"))
    return W.language_backlog(counted.select("code").union(spark.sql("SELECT explode(array('xx', 'yy'))")), available, missing)


# --- scalar functions -------------------------------------------------------------------------

@query("fun1_srt_time", f"SELECT o_orderkey, {time_sql('CAST(floor(o_totalprice * 1000 + 0.5) AS BIGINT)')} AS js, {time_sql('CAST(round_even(o_totalprice * 1000, 0) AS BIGINT)')} AS python FROM {{orders}}")
def _(v):
    return v("orders").select("o_orderkey", S.srt_time("o_totalprice").alias("js"), S.srt_time("o_totalprice", "python").alias("python"))


@query("fun2_parse_srt_time", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey * 3600000 + l_linenumber * 60000 + 5 * 1000 + l_suppkey % 1000 END AS t_ms FROM {lineitem}")
def _(v):
    text = F.format_string("%02d:%02d:05%s%03d", "l_partkey", F.col("l_linenumber"), F.when(F.col("l_linenumber") % 3 == 0, ".").otherwise(","), F.col("l_suppkey") % 1000)
    return v("lineitem").select("l_orderkey", "l_linenumber", S.parse_srt_ms(text).alias("t_ms"))


@query("fun3_format_duration", """SELECT o_orderkey, CASE WHEN d <= 0 THEN 'duration pending' WHEN n >= 3600 THEN n // 3600 || ' h ' || n % 3600 // 60 || ' min ' || n % 60 || ' s' WHEN n >= 60 THEN n // 60 || ' min ' || n % 60 || ' s' ELSE n || ' s' END AS text
    FROM (SELECT o_orderkey, o_totalprice / 60 - 100 AS d, CAST(floor(o_totalprice / 60 - 100) AS BIGINT) AS n FROM {orders}) x""")
def _(v):
    return v("orders").select("o_orderkey", S.format_duration(F.col("o_totalprice") / 60 - 100).alias("text"))


ONE = "CAST(floor({x} * 10 + 0.5) AS BIGINT) // 10 || '.' || CAST(floor({x} * 10 + 0.5) AS BIGINT) % 10"


def one_sql(x: str) -> str:
    return ONE.replace("{x}", x)


@query("fun4_format_bytes", f"""SELECT l_orderkey, l_linenumber, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN {one_sql('(b / 1024)')} || ' KB' WHEN b < 1073741824 THEN {one_sql('(b / 1048576)')} || ' MB' ELSE {one_sql('(b / 1073741824)')} || ' GB' END AS units,
    CASE WHEN b >= 1048576 THEN {one_sql('(b / 1048576)')} || ' MB' WHEN b >= 1024 THEN {one_sql('(b / 1024)')} || ' KB' ELSE b || ' B' END AS report, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN CAST(floor(b / 1024 + 0.5) AS BIGINT) || ' KiB' ELSE CAST(floor(b / 1048576 + 0.5) AS BIGINT) || ' MiB' END AS binary_
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * CASE l_linenumber % 3 WHEN 0 THEN 13 WHEN 1 THEN 12345 ELSE 98765432 END AS b FROM {{lineitem}}) x""")
def _(v):
    b = F.col("l_quantity").cast("bigint") * F.when(F.col("l_linenumber") % 3 == 0, 13).when(F.col("l_linenumber") % 3 == 1, 12345).otherwise(98765432)
    return v("lineitem").select("l_orderkey", "l_linenumber", S.format_bytes(b).alias("units"), S.format_bytes(b, "report").alias("report"), S.format_bytes(b, "binary").alias("binary_"))


@query("fun5_normalise_progress", """SELECT event_id, CAST(greatest(0, least(100, floor(CASE WHEN p >= 0 AND p <= 1 THEN p * 100 ELSE p END + 0.5))) AS INT) AS progress
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN value / 500 WHEN 1 THEN value WHEN 2 THEN value / 500 * 100 ELSE -value END AS p FROM {events}) x""")
def _(v):
    e, x = F.col("event_id"), F.col("value")
    p = F.when(e % 4 == 0, x / 500).when(e % 4 == 1, x).when(e % 4 == 3, -x)
    return v("events").select("event_id", S.normalise_progress(p, x, F.lit(500)).alias("progress"))


@query("fun6_job_progress", """SELECT event_id, CASE WHEN s = 'transcribing' THEN CAST(round_even(d / 64 * 55, 0) AS INT) WHEN s = 'translating' THEN CAST(55 + round_even(d / 64 * 35, 0) AS INT) END AS progress,
    CASE WHEN s = 'transcribing' THEN CAST(greatest(0, least(100, floor(p / 55 * 100 + 0.5))) AS INT) WHEN s IN ('translating', 'ready') THEN 100 END AS transcription, CASE WHEN s = 'transcribing' THEN 0 WHEN s = 'translating' THEN CAST(greatest(0, least(100, floor((p - 55) / 35 * 100 + 0.5))) AS INT) WHEN s = 'ready' THEN 100 END AS translation,
    CAST(floor(d % 4 * 25 + p / 100 * 25 + 0.5) AS INT) AS batch, CAST(floor(d / 64 * 100 + 0.5) AS INT) AS asset FROM (SELECT event_id, stage AS s, progress AS p, event_id % 65 AS d FROM (SELECT e.event_id, j.stage, j.progress FROM {events} e JOIN {v_job_events} j ON j.job_id = CAST(e.user_id AS STRING) AND j.ts = e.ts) q) x""")
def _(v):
    e = v("events").select("event_id", F.col("user_id").cast("string").alias("job_id"), "ts").join(v("v_job_events"), ["job_id", "ts"]).withColumn("d", F.col("event_id") % 65)
    one, two = S.stage_progress("stage", "progress")
    return e.select("event_id", S.job_progress("stage", "d", F.lit(64)).alias("progress"), one.alias("transcription"), two.alias("translation"), S.batch_progress("progress", F.col("d") % 4, F.lit(4)).alias("batch"), S.asset_progress("d", F.lit(64)).alias("asset"))


@query("fun7_messages", r"SELECT doc_id, CASE WHEN length(text) <= 180 THEN text ELSE substr(text, 1, 179) || '…' END AS short, regexp_extract(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[^\n]*$') AS last FROM {documents}")
def _(v):
    return v("documents").select("doc_id", S.truncate_message("text").alias("short"), S.last_line("text").alias("last"))


@query("fun8_versioned_url", "SELECT p_partkey, url || '?v=' || CASE WHEN p_partkey % 3 = 0 THEN 'unversioned' ELSE 'v' || p_partkey END AS url FROM {v_assets}")
def _(v):
    return v("v_assets").select("p_partkey", S.versioned_url("url", F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("v"), "p_partkey"))).alias("url"))


@query("fun9_manifest_issues", """WITH m AS (SELECT p_partkey, p_partkey % 2 AS a, p_partkey % 3 AS b, p_partkey % 5 AS c, p_partkey % 7 AS d FROM {part})
    SELECT p_partkey AS manifest_id, issue FROM (SELECT p_partkey, unnest([CASE WHEN a = 0 THEN 'version is required' END, CASE WHEN b = 0 THEN 'timeouts are required' END, CASE WHEN c = 0 THEN 'models.translation is required' END,
    CASE WHEN d = 0 THEN 'models.transcription.stage must be its key' END, CASE WHEN d = 1 THEN 'models.transcription.provider is required' END, CASE WHEN d = 2 THEN 'models.transcription.modelId is required' END,
    CASE WHEN d = 3 THEN 'models.transcription.assets[0].url must be relative' END, CASE WHEN d = 4 THEN 'models.transcription.assets[0].sha256 is required' END, CASE WHEN d = 5 THEN 'models.transcription.assets[0].bytes must be positive' END,
    CASE WHEN c <> 0 AND b = 1 THEN 'models.translation.assets must list an asset' END, CASE WHEN c <> 0 AND a = 1 THEN 'models.translation.strategy is required' END]) AS issue FROM m) x WHERE issue IS NOT NULL""")
def _(v):
    k = F.col("p_partkey")
    d = k % 7
    asset = lambda url, sha, size: F.struct(url.alias("url"), sha.alias("sha256"), size.cast("bigint").alias("bytes"))
    model = lambda key, stage, provider, strategy, model_id, assets: F.struct(F.lit(key).alias("key"), stage.alias("stage"), provider.alias("provider"), strategy.alias("strategy"), model_id.alias("model_id"), assets.alias("assets"))
    ok = asset(F.lit("models/x"), F.lit("ab"), F.lit(7))
    one = model("transcription", F.when(d == 0, "asr").otherwise("transcription"), F.when(d != 1, "p"), F.lit("s"), F.when(d == 2, "").otherwise("m"), F.array(asset(F.when(d == 3, "//cdn/x").otherwise("models/x"), F.when(d != 4, "ab"), F.when(d == 5, 0).otherwise(9))))
    two = model("translation", F.lit("translation"), F.lit("p"), F.when(k % 2 == 1, "").otherwise("s"), F.lit("m"), F.when(k % 3 != 1, F.array(ok)))
    rows = v("part").select(k.alias("manifest_id"), F.when(k % 2 != 0, "v1").alias("version"), (k % 3 != 0).alias("has_timeouts"), F.when(k % 5 == 0, F.array(one)).otherwise(F.array(one, two)).alias("models"))
    return A.manifest_issues(rows)


@query("fun9_checksums", """SELECT doc_id, coalesce(length(e) = 64 AND regexp_full_match(e, '[a-fA-F0-9]+') AND lower(e) = lower(sha256(text)), FALSE) AS ok FROM (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN upper(sha256(text)) WHEN 1 THEN substr(sha256(text), 2) WHEN 2 THEN sha256(text || ' ') WHEN 3 THEN NULL ELSE sha256(text) END AS e FROM {documents}) x""")
def _(v):
    k, own = F.col("doc_id") % 5, F.sha2("text", 256)
    expected = F.when(k == 0, F.upper(own)).when(k == 1, F.substring(own, 2, 64)).when(k == 2, F.sha2(F.concat("text", F.lit(" ")), 256)).when(k == 4, own)
    return v("documents").select("doc_id", expected.alias("expected"), own.alias("actual")).select("doc_id", F.coalesce(A.checksum_ok("expected", "actual"), F.lit(False)).alias("ok"))


@query("fun10_stage_text", f"""SELECT event_id, CASE stage WHEN 'audioExtraction' THEN 'Audio extraction' WHEN 'vad' THEN 'VAD / segmentation' WHEN 'transcription' THEN 'Transcription' WHEN 'translation' THEN 'Translation' ELSE 'SRT formatting' END || CASE WHEN runtime = 'browser' THEN ': Browser' ELSE ': Python fallback' END
    || ' (' || strategy || ')' || CASE WHEN runtime <> 'browser' AND stage <> 'srtFormatting' THEN ' via ' || {ENDPOINT} ELSE '' END || CASE WHEN reason IS NOT NULL THEN ' — fallback reason: ' || reason ELSE '' END
    || CASE WHEN event_id % 4 = 0 THEN ' — model bootstrap: bootstrap-required, ' || CASE WHEN b >= 1048576 THEN {one_sql('(b / 1048576)')} || ' MB' WHEN b >= 1024 THEN {one_sql('(b / 1024)')} || ' KB' ELSE b || ' B' END || ' remaining, missing a, b' ELSE '' END AS text FROM (SELECT *, event_id % 1000 * CASE WHEN event_id % 12 = 0 THEN 1 ELSE 2000 END AS b FROM {{v_stage_results}}) x""")
def _(v):
    r, e = v("v_stage_results"), F.col("event_id")
    endpoints = F.when(F.col("runtime") == "browser", F.array().cast("array<string>")).otherwise(A.endpoints_of(F.col("stage")))
    note = S.bootstrap_text(F.lit(None).cast("string"), e % 1000 * F.when(e % 12 == 0, 1).otherwise(2000), F.when(e % 4 == 0, F.array(F.lit("a"), F.lit(""), F.lit("b"))).otherwise(F.array().cast("array<string>")))
    rows = r.withColumn("endpoints", endpoints).withColumn("note", note)
    return rows.select("event_id", S.stage_text("stage", "runtime", "strategy", "endpoints", "reason", "note").alias("text"))


# --- streams and user functions ---------------------------------------------------------------

def job_events(v) -> DataFrame:
    e = v("v_job_events")
    return e.select("job_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "kind", "status", "stage", "progress")


def last_snapshots(out: DataFrame) -> DataFrame:
    return out.groupBy("job_id").agg(F.max_by(F.struct("status", "stage", "progress"), F.struct("epoch", "seq")).alias("s")).select("job_id", "s.*")


#: Longer than any table's time.
FOR_GOOD = 100 * 365 * 24 * live.HOUR_MS


def _job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's last snapshot of each job; the same rows as the batch form."""
    events = job_events(lambda n: view(spark, sf_dir, n))
    return last_snapshots(fed(in_parts(events, "ts", 2), lambda e: live.job_state_stream(e, keep_terminal_ms=FOR_GOOD, keep_idle_ms=FOR_GOOD), "jobs", "update"))


QUERIES["str1_job_state_stream"] = _job_stream
ORACLES["str1_job_state_stream"] = with_views("WITH " + SNAPSHOTS + " SELECT job_id, status, stage, progress FROM snap")

DONE, TOTAL = "(event_id % 65)", 64


def lined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress comes as lines of the workers, some of them no JSON or without a total; puts, ends and cancels as events."""
    own = spark.sql(f"SELECT user_id, event_id, {JOB_EVENT} FROM {{events}}", events=view(spark, sf_dir, "events"))
    # the SQL joins an event with all of its job's events of that time; the window has them next to each other, without another shuffle
    with_ids = own.withColumn("e", F.collect_list(F.struct("event_id")).over(Window.partitionBy("user_id", "ts"))).withColumn("e", F.explode("e"))
    e = with_ids.filter("job_id IS NOT NULL AND ts IS NOT NULL").withColumn("event_id", F.col("e.event_id")).withColumn("ts", F.col("ts").cast("timestamp"))
    line = F.when(F.col("event_id") % 11 == 0, "size=12").when(F.col("event_id") % 13 == 0, '{"done": 3, "total": 0}').when(F.col("event_id") % 17 == 0, '{"done": ').otherwise(F.to_json(F.struct(F.expr(DONE).alias("done"), F.lit(TOTAL).alias("total"))))
    worker = F.col("stage").isin("transcribing", "translating") & (F.col("kind") == "progress") & (F.col("status") == "running")
    return e.select("job_id", "seq", "ts", "kind", "status", "stage", "progress", F.when(worker, line).alias("line"))


def _progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events and lines as one stream; the last snapshot of each job."""
    return last_snapshots(fed(in_parts(lined_events(spark, sf_dir), "ts", 2), lambda r: live.job_state_of_lines(r, keep_terminal_ms=FOR_GOOD, keep_idle_ms=FOR_GOOD), "lines", "update"))


QUERIES["str1_progress_lines"] = _progress_lines
LINES = f"""lined AS (SELECT j.*, event_id, kind = 'progress' AND status = 'running' AND stage IN ('transcribing', 'translating') AS worker FROM {{v_job_events}} j JOIN {{events}} e ON j.job_id = CAST(e.user_id AS STRING) AND j.ts = e.ts),
    said AS (SELECT job_id, seq, ts, kind, status, stage, CASE WHEN NOT worker THEN progress WHEN stage = 'translating' THEN CAST(55 + round_even({DONE} / {TOTAL} * 35, 0) AS INT) ELSE CAST(round_even({DONE} / {TOTAL} * 55, 0) AS INT) END AS progress FROM lined WHERE NOT worker OR event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0)"""
ORACLES["str1_progress_lines"] = with_views("WITH " + LINES + ", " + SNAPSHOTS.replace("{v_job_events}", "said") + " SELECT job_id, status, stage, progress FROM snap")

#: The orders of a customer as the news of a job, the last of some customers a cancel; a job without news is dropped after so many days.
IDLE_DAYS, FEEDS = 120, 4


def expiring_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "orders")
    number, last = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")), F.count("*").over(Window.partitionBy("o_custkey"))
    rows = o.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"), number.alias("seq"), last.alias("last"))
    cancel = (F.col("seq") == F.col("last")) & (F.col("o_orderkey") % 2 == 0)
    return rows.select(F.col("o_custkey").cast("string").alias("job_id"), "seq", "ts", F.when(cancel, "cancel").otherwise("progress").alias("kind"), F.lit("running").alias("status"), F.lit("transcribing").alias("stage"), (F.col("o_orderkey") % 100).cast("int").alias("progress"))


def _expiring(spark: SparkSession, sf_dir: str, seen: Callable[[list], None] = lambda progress: None) -> DataFrame:
    """Jobs that a cancel finds no more, since they were dropped before, stay as they were."""
    idle = IDLE_DAYS * 24 * live.HOUR_MS
    return last_snapshots(fed(in_parts(expiring_jobs(spark, sf_dir), "ts", FEEDS), lambda e: live.job_state_stream(e, keep_terminal_ms=idle, keep_idle_ms=idle), "expiring", "update", seen))


QUERIES["str1_expiring_jobs"] = _expiring
EXPIRING = f"""o AS (SELECT CAST(o_custkey AS STRING) AS job_id, o_orderkey, epoch_us(o_orderdate) AS t, row_number() OVER w AS seq, count(*) OVER (PARTITION BY o_custkey) AS last FROM {{orders}} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    ends AS (SELECT min(t) AS low, max(t) AS high FROM o), p AS (SELECT o.*, least({FEEDS - 1}, CAST(floor((t - low) * {FEEDS} / (high - low)) AS INT)) AS feed FROM o, ends),
    marks AS (SELECT feed, max(max(t)) OVER (ORDER BY feed) - 600000000 AS mark FROM p GROUP BY feed),
    pairs AS (SELECT b.job_id, a.t AS before_t, a.feed AS before_feed, b.feed, a.o_orderkey % 100 AS before_progress, b.o_orderkey % 100 AS progress, b.o_orderkey % 2 = 0 AS cancel, a.job_id IS NOT NULL AS known FROM p b LEFT JOIN p a ON a.job_id = b.job_id AND a.seq = b.seq - 1 WHERE b.seq = b.last),
    judged AS (SELECT pairs.*, cancel AND (NOT known OR before_feed < pairs.feed AND before_t + {IDLE_DAYS} * 86400000000 <= m.mark) AS lost FROM pairs LEFT JOIN marks m ON m.feed = pairs.feed - 1)"""
ORACLES["str1_expiring_jobs"] = with_views("WITH " + EXPIRING + """ SELECT job_id, CASE WHEN cancel AND NOT lost THEN 'cancelled' ELSE 'running' END AS status, CASE WHEN cancel AND NOT lost THEN 'cancelled' ELSE 'transcribing' END AS stage, CAST(CASE WHEN cancel THEN before_progress ELSE progress END AS INT) AS progress FROM judged WHERE known OR NOT cancel""")


def voiced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), (-F.col("value")).alias("level_db"), "event_id")


def sessions_of(frames: DataFrame) -> DataFrame:
    return live.speech_sessions_stream(frames, noise_db=-35.0, gap="1 hour", max_s=1800.0)


def _speech_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames in one batch, so that none is late: the sessions that the watermark has closed."""
    out = fed([voiced_frames(spark, sf_dir)], sessions_of, "speech", "append")
    return out.select("track_id", "n_frames", us("start"), us("end"))


def _late_frames(spark: SparkSession, sf_dir: str, seen: Callable[[list], None] = lambda progress: None) -> DataFrame:
    """Frames in the order of time in four batches, but a tenth of the first batch's come with the last: too late, so they are in no session."""
    frames = voiced_frames(spark, sf_dir)
    part = by_time(frames, "ts", FEEDS)
    given = F.when((part == 0) & (F.col("event_id") % 10 == 3), FEEDS - 1).otherwise(part)
    out = fed([frames.filter(given == k) for k in range(FEEDS)], sessions_of, "late", "append", seen)
    return out.select("track_id", "n_frames", us("start"), us("end"))


SESSIONS = """voiced AS (SELECT CAST(user_id AS STRING) AS track_id, epoch_us(ts) AS t, event_id FROM {events} WHERE -value > -35), in_time AS (SELECT * FROM voiced WHERE {in_time}), begun AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY track_id ORDER BY t) <= 3600000000 THEN 0 ELSE 1 END AS b FROM in_time),
    numbered AS (SELECT *, sum(b) OVER (PARTITION BY track_id ORDER BY t, b) AS k FROM begun), sessions AS (SELECT track_id, count(*) AS n_frames, min(t) AS start_us, max(t) AS end_us FROM numbered GROUP BY track_id, k HAVING max(t) - min(t) >= 400000 AND max(t) + 3600000000 <= (SELECT max(t) // 1000 * 1000 - 10000000 FROM voiced))"""
CLOSED = ", " + SPLIT.replace("{src}", "sessions").replace("12000000", "1800000000") + " SELECT track_id, n_frames, low AS start_us, high AS end_us FROM cut"
IN_TIME = f"event_id % 10 <> 3 OR (t - (SELECT min(epoch_us(ts)) FROM {{events}})) * {FEEDS} >= (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM {{events}})"
QUERIES["str2_speech_sessions_stream"] = _speech_stream
ORACLES["str2_speech_sessions_stream"] = with_views("WITH " + SESSIONS.replace("{in_time}", "TRUE") + CLOSED)
QUERIES["str2_late_frames"] = _late_frames
ORACLES["str2_late_frames"] = with_views("WITH " + SESSIONS.replace("{in_time}", IN_TIME) + CLOSED)


def bracketing():
    return lambda texts: [f"<{t}>" for t in texts]


@query("udf1_map_model", r"SELECT track_id, idx AS index, CASE WHEN regexp_full_match(text, '\s*') THEN '' ELSE '<' || text || '>' END AS translated_text FROM {v_segments}")
def _(v):
    return map_model(segments(v), bracketing).select("track_id", "index", "translated_text")


def joining():
    """Each text with the texts of its batch before it: a function of context."""
    return lambda texts: ["|".join(texts[: k + 1]) for k in range(len(texts))]


@query("udf1_ordered_batches", r"""WITH b AS (SELECT track_id, idx, text, (idx - 1) // 3 AS batch FROM {v_segments}) SELECT track_id, idx AS index, CASE WHEN regexp_full_match(text, '\s*') THEN '' ELSE
    string_agg(CASE WHEN NOT regexp_full_match(text, '\s*') THEN text END, '|') OVER (PARTITION BY track_id, batch ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS translated_text FROM b""")
def _(v):
    return map_model(segments(v), joining, batch=3, track="track_id", order=("index",)).select("track_id", "index", "translated_text")
