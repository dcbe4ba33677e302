"""Views over the star-schema tables that stand for the records of a media archive.

Each is one SQL text that reads the same in Spark and DuckDB but for the microseconds of a timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()

#: The columns of v_job_events, for queries that need others of the same event beside them.
JOB_EVENT = """CAST(user_id AS STRING) AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, ts,
        CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'cancel' WHEN event_type = 'view' THEN 'put' ELSE 'progress' END AS kind,
        CASE WHEN value > 200 THEN 'failed' WHEN event_type = 'view' THEN 'queued' WHEN event_type = 'signup' AND value > 100 THEN 'succeeded' ELSE 'running' END AS status,
        CASE event_type WHEN 'click' THEN 'transcribing' WHEN 'purchase' THEN 'translating' WHEN 'signup' THEN 'ready' ELSE 'queued' END AS stage,
        CAST(event_id % 100 AS INT) AS progress"""

VIEWS = {
    # conversations as tracks: a turn lasts 40 ms a character
    "v_segments": """SELECT CAST(conv_id AS STRING) AS track_id, CAST(turn + 1 AS INT) AS idx,
        CAST(sum(length(text) * 40) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(text) * 40 AS BIGINT) AS start_ms,
        CAST(sum(length(text) * 40) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_ms,
        text FROM {conversations}""",
    # a month of events as twelve minutes of a user's track
    "v_timed": """SELECT CAST(user_id AS STRING) AS track_id, event_id, event_type, value, ts,
        CAST(floor(({US} - 1704067200000000) / 3600) AS BIGINT) AS t_us FROM {events}""",
    "v_tracks": "SELECT DISTINCT track_id, CAST(720 AS DOUBLE) AS duration_s FROM {v_timed}",
    "v_silences": """SELECT track_id, event_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY ts, event_id) AS INT) AS k,
        t_us AS start_us, t_us + CAST(floor(value * 10 + 0.5) AS BIGINT) * 1000 AS end_us FROM {v_timed}""",
    "v_log": """SELECT track_id, 2 * k - 1 AS line_no, CASE WHEN event_id % 11 = 0 THEN 'size=12' ELSE 'silence_start: ' || CAST(floor(start_us / 1000) AS BIGINT) END AS line FROM {v_silences} WHERE event_id % 7 <> 0
        UNION ALL SELECT track_id, 2 * k, 'x silence_end: ' || CAST(floor(end_us / 1000) AS BIGINT) || ' | y' FROM {v_silences} WHERE event_id % 5 <> 0""",
    "v_clips": "SELECT source AS track_id, doc_id AS clip_no, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE lang END AS language_code, (n_chars % 1000) / 1000 AS probability FROM {documents}",
    "v_media": """SELECT doc_id, source || '_é ' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.mov' WHEN doc_id % 5 = 1 THEN '.WAV' ELSE '.mp4' END AS file_name,
        CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(n_chars * 3 AS DOUBLE) END AS duration_s, n_chars * 65536 AS size_bytes, n_chars % 400 AS n_segments,
        CASE doc_id % 3 WHEN 0 THEN 'audioExtraction' WHEN 1 THEN 'transcription' ELSE 'translation' END AS stage FROM {documents}""",
    # neighbours of one source within a range of ids, so that no window grows with the table
    "v_pairs": """SELECT * FROM (SELECT doc_id AS pair_id, text AS left_text, lead(text) OVER (PARTITION BY source, CAST(floor(doc_id / 1000) AS BIGINT) ORDER BY doc_id) AS right_text FROM {documents}) p WHERE right_text IS NOT NULL""",
    # lines of documents and of benchmark items
    "v_doc_lines": "SELECT doc_id, {EXPLODE} AS line FROM {documents}",
    "v_item_lines": "SELECT item_id, {EXPLODE} AS line FROM {benchmark}",
    "v_direct": """SELECT 'n' || c_nationkey AS source, 'n' || s_nationkey AS target FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
        JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey HAVING count(*) % 3 = 0""",
    "v_requests": "SELECT o_orderkey, 'n' || (o_custkey % 25) AS source, 'n' || (o_orderkey % 25) AS target FROM {orders}",
    "v_job_events": f"SELECT {JOB_EVENT} FROM {{events}}",
    "v_stage_rows": """SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id, ts, event_id,
        CASE event_type WHEN 'view' THEN 'audioExtraction' WHEN 'click' THEN 'vad' WHEN 'purchase' THEN 'transcription' WHEN 'signup' THEN 'translation' ELSE 'srtFormatting' END AS stage,
        CASE WHEN event_id % 3 = 0 THEN 'server-fallback' ELSE 'browser' END AS runtime,
        CASE WHEN event_id % 5 = 0 THEN 'cloud-provider' WHEN event_id % 17 = 0 THEN 'unavailable' ELSE 'local-model' END AS strategy,
        CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'failed ' || event_id ELSE NULL END AS reason FROM {events}""",
    "v_stage_results": """SELECT run_id, stage, runtime, strategy, reason, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY ts DESC, event_id DESC) AS n FROM {v_stage_rows}) r WHERE n = 1""",
    "v_assets": """SELECT p_brand AS stage, p_name AS name, 'models/' || p_partkey AS url, CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS bytes, md5(p_name) AS sha256, p_partkey % 19 <> 0 AS required, p_partkey FROM {part}""",
    "v_cached": "SELECT DISTINCT 'models/' || l_partkey || '?v=v1' AS url FROM {lineitem} WHERE l_shipdate < '1996-01-01'",
    "v_catalogue": "SELECT DISTINCT lang AS code, upper(lang) AS name FROM {documents} WHERE lang <> 'es' UNION ALL SELECT 'xx', 'XX'",
}

EXPLODES = {
    "spark": {"US": "unix_micros(CAST(ts AS TIMESTAMP))", "EXPLODE": "explode(split(text, '\\n'))"},
    "duckdb": {"US": "epoch_us(ts)", "EXPLODE": "unnest(string_split(text, chr(10)))"},
}


def names_in(sql: str) -> list[str]:
    return [n for n in re.findall(r"\{(\w+)\}", sql) if n in VIEWS or n in TABLES]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    for k, v in EXPLODES["spark"].items():
        sql = sql.replace("{" + k + "}", v)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in names_in(VIEWS[name])})


def with_views(sql: str) -> str:
    """DuckDB text of a query on views: the views that it needs come before it."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for n in names_in(text):
            if n in VIEWS and n not in ordered:
                need(VIEWS[n])
                if n not in ordered:
                    ordered.append(n)

    need(sql)
    parts = []
    for n in ordered:
        body = VIEWS[n]
        for k, v in EXPLODES["duckdb"].items():
            body = body.replace("{" + k + "}", v)
        parts.append(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', body)})")
    text = re.sub(r"\{(\w+)\}", r"\1", sql)
    if not parts:
        return text
    head = "WITH RECURSIVE " if text.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    rest = re.sub(r"^\s*WITH( RECURSIVE)?\s+", "", text, flags=re.IGNORECASE) if text.lstrip().upper().startswith("WITH") else None
    return head + ", ".join(parts) + (", " + rest if rest is not None else " " + text)
