"""Files as data sources, batches in order, streams with expiry and late rows, skewed lines, long tracks, members of JSON objects."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuelake.operators import aggregates as A, segments as G, windows as W
from cuelake.operators.model_batches import map_model
from cuelake.plans import queries as Q
from cuelake.plans.feeds import fed
from cuelake.sources import files as FS, payloads as P, subtitles as T
from cuelake.streaming import live

SF = "/root/testdata/sf0.001"


# --- files ------------------------------------------------------------------------------------

def plain_inventory(top: Path, root: Path) -> list[tuple]:
    out = []
    for path in sorted(top.rglob("*")):
        if path.is_file() and not any(part.startswith(".") for part in path.relative_to(top).parts):
            data = path.read_bytes()
            out.append((path.stem, path.relative_to(root).as_posix(), len(data), hashlib.sha256(data).hexdigest(), True))
    return out


def test_inventory_of_a_tree(spark, tmp_path):
    """Names with an underscore or several dots, nested and empty folders, hidden files and folders; parts are sorted one by one."""
    for name in ("models/_b.bin", "models/_sub/z.onnx", "models/a/b.tar.gz", "models/a.b/c", "models/a/.hidden", "models/.git/x", "models/none", "models/é ü.txt", "models/deep/er/_x_/y.json"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode() * 100)
    (tmp_path / "models" / "nothing").mkdir()
    got = [tuple(r) for r in FS.file_inventory(spark, f"file://{tmp_path}/models", f"file://{tmp_path}").collect()]
    assert got == plain_inventory(tmp_path / "models", tmp_path) and len(got) == 7
    assert [r[1] for r in got][:2] == ["models/_b.bin", "models/_sub/z.onnx"]
    assert [tuple(r)[1] for r in FS.file_inventory(spark, f"{tmp_path}/models/a").collect()] == ["b.tar.gz"]


def test_empty_trees_are_errors(spark, tmp_path):
    (tmp_path / "some" / ".hidden").mkdir(parents=True)
    (tmp_path / "some" / ".hidden" / "x").write_text("x")
    for name in ("some", "absent"):
        with pytest.raises(PySparkException, match="No packaged model files found"):
            FS.file_inventory(spark, f"file://{tmp_path}/{name}").collect()
    with pytest.raises(PySparkException, match="is not under"):
        FS.file_inventory(spark, f"file://{tmp_path}/some", f"file://{tmp_path}/other").collect()


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: it is hashed in chunks."""
    size = (1 << 31) + 12345
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
    (row,) = FS.file_inventory(spark, f"file://{tmp_path}").collect()
    digest, left = hashlib.sha256(), size
    while left:
        digest.update(bytes(min(left, 1 << 24)))
        left -= min(left, 1 << 24)
    assert (row.bytes, row.sha256) == (size, digest.hexdigest())


def test_ranges_of_files():
    rows = [(f"f{k}", size) for k, size in enumerate([1, FS.RANGE_BYTES, 5, 5, 2 * FS.RANGE_BYTES, *[0] * 2500])]
    parts = FS.ranges(rows)
    assert [n for p in parts for n in p.files] == [n for n, _ in rows]
    assert [len(p.files) for p in parts] == [1, 1, 2, 1, 1000, 1000, 500]


def srt_documents(spark, rows):
    return spark.createDataFrame(rows, "file_name string, srt_text string")


def names(path: Path) -> list[str]:
    return sorted(p.relative_to(path).as_posix() for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_subtitle_files_round_trip(spark, tmp_path):
    where, rows = f"file://{tmp_path}/out", [(f"t{k}.fr.srt", f"1\n00:00:00,000 --> 00:00:01,000\nc {k} é\n") for k in range(50)] + [("sub/empty.srt", ""), ("sub/null.srt", None)]
    FS.write_srt(srt_documents(spark, rows).repartition(5), where)
    assert names(tmp_path / "out") == sorted(n for n, _ in rows)
    got = {(r.track_id, r.srt_text, r.bytes) for r in FS.read_srt(spark, where).collect()}
    assert got == {(n[:-4], t or "", len((t or "").encode())) for n, t in rows}
    FS.write_srt(srt_documents(spark, rows[:1] + [("new.srt", "x")]), where, "append")
    assert names(tmp_path / "out") == sorted([n for n, _ in rows] + ["new.srt"])
    FS.write_srt(srt_documents(spark, [("only.srt", "y")]), where)
    assert names(tmp_path / "out") == ["only.srt"]
    assert FS.read_srt(spark, f"{where}/only.srt").first().track_id == "only"


@pytest.mark.parametrize("bad", ["a.srt", "../b.srt", "/b.srt", "_b.srt", "b.txt", "", None])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    """A name twice, or one that is no name of a subtitle file: what was there stays as it was."""
    where = f"file://{tmp_path}/out"
    FS.write_srt(srt_documents(spark, [("old.srt", "o")]), where)
    with pytest.raises(PySparkException):
        FS.write_srt(srt_documents(spark, [("a.srt", "1"), (bad, "2")]).repartition(2), where)
    assert names(tmp_path / "out") == ["old.srt"] and names(tmp_path) == ["out/old.srt"]


def test_byte_order_mark_and_bad_bytes(spark, tmp_path):
    text = "﻿1\n00:00:00,000 --> 00:00:01,000\na\n"
    (tmp_path / "a.srt").write_text(text, encoding="utf-8")
    (tmp_path / "b.srt").write_bytes(b"1\n00:00:00,000 --> 00:00:01,000\n\xff\xfe\n")
    got = {r.track_id: (r.bytes, r.blocks, r.issues) for r in A.srt_diagnostics(FS.read_srt(spark, f"file://{tmp_path}")).collect()}
    assert got == {"a": (len(text.encode()), 1, 0), "b": (35, 1, 0)}


def test_subtitle_files_as_a_stream(spark, tmp_path):
    """Files that are moved into place later are seen, each once."""
    where, out = f"file://{tmp_path}/in", []
    for k in range(3):
        FS.write_srt(srt_documents(spark, [(f"t{k}-{j}.srt", f"x{k}") for j in range(3)]), where, "append")
        q = FS.stream_srt(spark, where).writeStream.option("checkpointLocation", f"file://{tmp_path}/state").foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(out) == sorted((f"t{i}-{j}", f"x{i}", 2) for i in range(k + 1) for j in range(3))


# --- payloads ---------------------------------------------------------------------------------

@pytest.mark.parametrize(
    ("element", "expected"),
    [
        ('{"start": null, "end": 1}', "Segment times must be numbers."), ('{"start": 0, "end": null}', "Segment times must be numbers."), ('{"start": [0], "end": 1}', "Segment times must be numbers."), ('{"start": "x", "end": 1}', "Segment times must be numbers."),
        ('{"start": 0, "end": 1, "index": null}', "Segment index must be a number."), ('{"start": 0, "end": 1, "index": "7.5"}', "Segment index must be a number."), ('{"start": 0, "end": 1, "index": {}}', "Segment index must be a number."),
        ("null", "Each segment must be an object."), ("3", "Each segment must be an object."), ('"{}"', "Each segment must be an object."), ("[]", "Each segment must be an object."), ("{}", "Segment end must be after its start."),
        ('{"end": true}', (1, 0.0, 1.0, "")), ('{"start": false, "end": 2, "index": true}', (1, 0.0, 2.0, "")), ('{"end": 1, "index": 3e9}', (3_000_000_000, 0.0, 1.0, "")), ('{"end": 1, "index": 9007199254740993}', (9007199254740993, 0.0, 1.0, "")),
        ('{"end": 1, "index": -7.9}', (-7, 0.0, 1.0, "")), ('{"end": " 1_0.5 ", "index": " 12 "}', (12, 0.0, 10.5, "")), ('{"end": 1e2, "text": " a\\n"}', (1, 0.0, 100.0, "a")), ('{"end": 1, "text": null}', (1, 0.0, 1.0, "None")), ('{"end": 1, "text": true}', (1, 0.0, 1.0, "True")), ('{"end": 1, "text": 5}', (1, 0.0, 1.0, "5")),
    ],
)
def test_members_of_segments(spark, element, expected):
    (row,) = P.read_text_segments(spark.createDataFrame([("t", f"[{element}]")], "track_id string, payload string")).collect()
    assert (row["reason"] if isinstance(expected, str) else (row["index"], row["start"], row["end"], row["text"])) == expected


def test_payloads_that_are_no_lists(spark):
    rows = [(str(k), p) for k, p in enumerate([None, "", "{}", "[]", "nonsense", "[1", '"x"', "null"])]
    got = P.read_segments(spark.createDataFrame(rows, "track_id string, payload string")).collect()
    assert {(r.track_id, r.reason) for r in got} == {(k, "At least one segment is required.") for k, _ in rows}


# --- batches in order -------------------------------------------------------------------------

def test_batches_keep_the_order(spark):
    """Over several tasks, Arrow batches and tracks, the function sees adjoining rows of one track in order."""
    rows = [(t, k, f"{t}{k}" if k % 4 else " ") for t, n in (("a", 2500), ("b", 7), ("c", 1)) for k in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "track_id string, index int, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {(r.track_id, r["index"]): r.translated_text for r in map_model(df, lambda: lambda texts: ["|".join(texts)] * len(texts), batch=3, track="track_id", order=("index",)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = {"a": 2500, "b": 7, "c": 1}
    assert len(got) == len(rows)
    for (t, k), text in got.items():
        mates = [f"{t}{j}" for j in range(k // 3 * 3, min(k // 3 * 3 + 3, n[t])) if j % 4]
        assert text == ("|".join(mates) if k % 4 else "")


def test_ordered_batches_edges(spark):
    """A wrong number of lines is asked again text by text; nulls, empty tables, other types and names are handed on."""
    df = spark.createDataFrame([(1, 1, "a\nb", {"x": [1]}), (1, 2, None, None), (1, 3, "c", None), (None, 1, "d", None)], "track long, at int, text string, __more map<string,array<int>>")
    out = map_model(df, lambda: lambda texts: [x for t in texts for x in t.split("\n")], track="track", order=("at",), out_col="said")
    assert {(r.track, r["at"], r.said) for r in out.collect()} == {(1, 1, "a b"), (1, 2, ""), (1, 3, "c"), (None, 1, "d")}
    assert out.columns == [*df.columns, "said"] and out.filter("at = 1 AND track = 1").first()["__more"] == {"x": [1]}
    assert map_model(df.limit(0), lambda: lambda texts: texts, track="track", order=("at",)).collect() == []


# --- streams ----------------------------------------------------------------------------------

JOBS = "job_id string, seq long, ts timestamp, kind string, status string, stage string, progress int"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def news(spark, *rows):
    return spark.createDataFrame([(j, s, START + dt.timedelta(hours=h), k, st, "x", p) for j, s, h, k, st, p in rows], JOBS)


def state_rows(reports: list) -> int:
    return [r["stateOperators"][0]["numRowsTotal"] for r in reports if r["stateOperators"]][-1]


def test_finished_and_abandoned_jobs_leave_the_state(spark):
    """One job ends, one is abandoned, one goes on; at the end all are gone, and so are the events that are too late."""
    parts = [
        news(spark, ("done", 1, 0, "put", "queued", 0), ("done", 2, 1, "progress", "succeeded", 100), ("left", 1, 0, "put", "running", 5), ("on", 1, 0, "put", "running", 1)),
        news(spark, ("on", 2, 30, "progress", "running", 50)),  # done is dropped
        news(spark, ("done", 3, 40, "progress", "running", 7), ("done", 9, 2, "progress", "failed", 9), ("on", 3, 40, "cancel", None, None), ("tick", 1, 150, "put", "running", 1)),  # a new job of that name; one event late
        news(spark, ("left", 2, 300, "cancel", None, None), ("other", 1, 900, "put", "succeeded", 1)),  # left was dropped: nothing to cancel
        news(spark, ("last", 1, 2000, "cancel", None, None)),
    ]
    sizes: list[int] = []
    out = fed(parts, lambda e: live.job_state_stream(e, keep_terminal_ms=10 * live.HOUR_MS, keep_idle_ms=100 * live.HOUR_MS), "expiry", "update", lambda r: sizes.append(state_rows(r)))
    got = sorted((r.job_id, r.seq, r.status, r.progress) for r in out.collect())
    assert got == sorted([("done", 2, "succeeded", 100), ("left", 1, "running", 5), ("on", 1, "running", 1), ("on", 2, "running", 50), ("done", 3, "running", 7), ("on", 3, "cancelled", 50), ("tick", 1, "running", 1), ("other", 1, "succeeded", 1)])
    assert sizes[0] > 0 and sizes[-1] == 0


def test_jobs_of_one_bucket_leave_one_by_one(spark):
    """All jobs share a bucket, so one value of the state and one timer; each still goes at its own time."""
    parts = [
        news(spark, ("done", 1, 1, "progress", "succeeded", 100), ("left", 1, 0, "put", "running", 5), ("on", 1, 0, "put", "running", 1), *((f"more{k}", 1, 0, "put", "running", k) for k in range(40))),
        news(spark, ("on", 2, 30, "progress", "running", 50)),  # done is dropped
        news(spark, ("done", 3, 40, "cancel", None, None), ("left", 3, 40, "cancel", None, None), ("on", 3, 40, "cancel", None, None), ("tick", 1, 150, "put", "running", 1)),  # only done has gone
        news(spark, ("more7", 2, 151, "cancel", None, None), ("left", 4, 151, "put", "queued", 0), ("last", 1, 2000, "cancel", None, None)),  # more7 and left were dropped
    ]
    sizes: list[int] = []
    out = fed(parts, lambda e: live.job_state_stream(e, keep_terminal_ms=10 * live.HOUR_MS, keep_idle_ms=100 * live.HOUR_MS, buckets=1), "bucket", "update", lambda r: sizes.append(state_rows(r)))
    got = sorted((r.job_id, r.seq, r.status, r.progress) for r in out.collect())
    first = [("done", 1, "succeeded", 100), ("left", 1, "running", 5), ("on", 1, "running", 1), *((f"more{k}", 1, "running", k) for k in range(40))]
    assert got == sorted([*first, ("on", 2, "running", 50), ("left", 3, "cancelled", 5), ("on", 3, "cancelled", 50), ("tick", 1, "running", 1), ("left", 4, "queued", 0)])
    assert 0 < sizes[0] < 10 and sizes[-1] == 0


def test_stream_begins_with_snapshots(spark):
    """The batch form's snapshots are what the stream starts from."""
    before = news(spark, ("a", 5, 1, "put", "running", 10), ("b", 5, 1, "put", "failed", 20))
    after = news(spark, ("a", 4, 2, "progress", "failed", 99), ("a", 6, 2, "cancel", None, None), ("b", 6, 2, "cancel", None, None), ("c", 1, 2, "cancel", None, None))
    out = fed([after], lambda e: live.job_state_stream(e, W.job_snapshots(before)), "initial", "update")
    assert [tuple(r)[:5] for r in out.collect()] == [("a", 6, "cancelled", "cancelled", 10)]


def test_lines_of_workers(spark):
    lines = ['{"done": 1, "total": 2}', '{"done": 3, "total": 2.0}', '{"done": 1}', '{"done": 1, "total": 0}', '{"done": "x", "total": 2}', "[1, 2]", "size=12", "", None]
    df = spark.createDataFrame([("j", k, START, "translating", line) for k, line in enumerate(lines)] + [("j", 99, START, "transcribing", lines[0])], "job_id string, seq long, ts timestamp, stage string, line string")
    assert sorted((r.seq, r.progress) for r in live.progress_events(df).collect()) == [(0, 73), (1, 107), (99, 28)]  # halves go to the even number


def test_late_frames_are_dropped(spark):
    """The watermark that the batches before have set drops them, and the report says how many."""
    reports: list = []
    Q._late_frames(spark, SF, reports.extend).collect()
    frames = spark.read.parquet(f"{SF}/events.parquet").filter("-value > -35")
    low, high = frames.sparkSession.read.parquet(f"{SF}/events.parquet").agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    late = frames.filter("event_id % 10 = 3").filter((F.unix_micros(F.col("ts").cast("timestamp")) - low) * Q.FEEDS < high - low).count()
    assert late and sum(int(o["numRowsDroppedByWatermark"]) for r in reports for o in r["stateOperators"]) == late


# --- skewed lines, long tracks ----------------------------------------------------------------

def test_line_pairs(spark):
    """One line in half of all documents is dealt over several sub-keys; blank lines make no pair."""
    rng = random.Random(4)
    lines = [f"line {k}" for k in range(30)] + ["", "  "]
    docs = [(k, "\n".join([*(["hot"] if k % 2 else []), *rng.choices(lines, k=3)])) for k in range(400)]
    items = [(k, "\n".join([*(["hot"] if k < 2 else []), f"line {k}", f"line {k}", ""])) for k in range(12)]
    left, right = spark.createDataFrame(docs, "left_id long, text string"), spark.createDataFrame(items, "right_id long, text string")
    plain = {(d, i) for d, a in docs for i, b in items if {x for x in a.split("\n") if x.strip()} & {x for x in b.split("\n") if x.strip()}}
    for hot_rows in (20, 100_000):
        got = [tuple(r) for r in A.line_pairs(left, right, hot_rows=hot_rows).collect()]
        assert len(got) == len(plain) and set(got) == plain
    both = left.join(right.withColumnRenamed("text", "other"), F.lit(True)).select(F.concat_ws("-", "left_id", "right_id").alias("pair_id"), "left_id", "right_id", F.col("text").alias("left_text"), F.col("other").alias("right_text"))
    pairs = A.line_pairs(left, right)
    expected = {(r.pair_id, r.similarity) for r in A.text_similarity(both.join(pairs, ["left_id", "right_id"])).collect()}
    assert {(f"{r.left_id}-{r.right_id}", r.similarity) for r in A.document_similarity(pairs, left, right).collect()} == expected


def test_token_counts(spark):
    """Lines with an arrow go, whatever ends a line; those beside them stay."""
    text = "Alpha the beta\r\n1\r\n00:00:01,000 --> 00:00:02,000 gone\rgamma\n--> gone\nABC ab abcd-efg --\n> beta é12xyz\nlast -->"
    rows = [(1, text), (2, None), (3, ""), (4, "12\n\n 7 "), (5, "x" * 5000 + "\n" + "word " * 5000 + "-->\nend")]
    got = {(r.k, r.token): r.n for r in A.token_counts(spark.createDataFrame(rows, "k int, text string"), "k", "text").collect()}
    assert got == {(1, "alpha"): 1, (1, "beta"): 2, (1, "gamma"): 1, (1, "abc"): 1, (1, "abcd"): 1, (1, "efg"): 1, (1, "xyz"): 1, (5, "x" * 5000): 1, (5, "end"): 1}


def test_cue_diagnostics(spark):
    """The same figures as from the lists of durations, also without a cue that lasts."""
    rng = random.Random(6)
    cues = [(str(t), k, s := rng.randrange(10**6), s + rng.choice([-5, 0, 1, 400, 400, 700, 3000])) for t in range(12) for k in range(rng.randint(1, 40))] + [("none", 0, 7, 7)]
    got = {r.track_id: (r.cues, r.last_end_ms, r.median_ms, r.p90_ms) for r in A.cue_diagnostics(spark.createDataFrame(cues, "track_id string, k int, start_ms long, end_ms long")).collect()}
    for track in {c[0] for c in cues}:
        own = [c for c in cues if c[0] == track]
        lasting = sorted(e - s for _, _, s, e in own if e > s)
        n = len(lasting)
        median = (lasting[(n - 1) // 2] + lasting[n // 2]) / 2 if n else 0.0
        assert got[track] == (len(own), max(c[3] for c in own), median, lasting[(9 * n + 9) // 10 - 1] if n else 0)


def test_a_track_of_ten_million_cues(spark):
    cues = spark.range(10_000_000).select(F.lit("t").alias("track_id"), (F.col("id") * 5000).alias("start_ms"), (F.col("id") * 5000 + 1 + F.col("id") % 1000).alias("end_ms"))
    r = A.cue_diagnostics(cues).first()
    assert (r.cues, r.median_ms, r.p90_ms, r.last_end_ms) == (10_000_000, 500.5, 900, 9_999_999 * 5000 + 1000)


def test_composed_subtitles_fit_the_writer(spark, tmp_path):
    """SNK-1, its file names and its files together."""
    s = spark.createDataFrame([("a", 1, 0.0, 1.5, "Bonjour", "Hello"), ("a", 2, 61.25, 62.75, "Au revoir", None)], "track_id string, index int, start double, end double, text string, translated_text string")
    FS.write_srt(T.compose_srt(s).select(F.concat("track_id", F.lit(".fr-en.srt")).alias("file_name"), "srt_text"), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "a.fr-en.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,500\nHello\n\n2\n00:01:01,250 --> 00:01:02,750\nAu revoir\n"
    assert os.listdir(tmp_path) == ["out"]


def test_long_samples_of_times_that_no_double_holds(spark):
    """0.000978 s times a million is just under 978 and 0.001955 s just over 1955; neither may bring in a sample beside the span."""
    samples = spark.createDataFrame([("t", n, n) for n in (977, 978, 1954, 1955)], "track_id string, sample_no long, value long")
    spans = spark.createDataFrame([("t", 1, 0.000978, 0.001955)], "track_id string, k int, start double, end double")
    rates = spark.createDataFrame([("t", 1_000_000)], "track_id string, rate int")
    assert sorted(r.value for r in G.slice_long_samples(spans, samples, rates).collect()) == [978, 1954]


def test_pairs_are_compared_in_their_own_rows(spark):
    """No shuffle of tokens but for rows that share a key, whose counts are added up; a word of many repeats needs no stack."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["alpha", "alphab", "beta", "the", "ab", "Gamma", "x1yzz", "1\n2 --> 3\nno"]) for _ in range(rng.randrange(40)))
    rows = [(k % 50, text(), text()) for k in range(60)] + [(70, "spam " * 50_000, "spam " * 20_000 + "spa"), (71, None, None), (72, None, "word"), (73, "the", "and"), (None, "one", "two"), (None, "one", "two")]
    pairs = spark.createDataFrame(rows, "pair_id int, left_text string, right_text string")
    expected = A.similarity_of_counts(A.token_counts(pairs, "pair_id", "left_text"), A.token_counts(pairs, "pair_id", "right_text"), pairs, ["pair_id"])
    found = A.text_similarity(pairs)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    lone = A.text_similarity(pairs.filter("pair_id >= 70")).filter("pair_id = 70")
    assert lone.first().similarity == 40_000 / 70_001
    assert pairs.filter("pair_id = 73").select(A.numbered_tokens("left_text").alias("t")).first().t == []


def test_a_stream_keeps_no_value_for_each_job(spark):
    """Many jobs, few values in the state; the last snapshots are those of the batch form."""
    events = [(f"j{k}", s, k, "progress" if s < 3 or k % 2 else "cancel", "running", s) for k in range(200) for s in (1, 2, 3)]
    sizes: list[int] = []
    out = fed([news(spark, *[e for e in events if e[1] < 3]), news(spark, *[e for e in events if e[1] == 3])], lambda e: live.job_state_stream(e, keep_idle_ms=10**12, keep_terminal_ms=10**12, late="400 hours", buckets=4), "few", "update", lambda r: sizes.append(state_rows(r)))
    batch = {r.job_id: (r.status, r.progress) for r in W.job_snapshots(news(spark, *events)).collect()}
    assert {r.job_id: (r.status, r.progress) for r in Q.last_snapshots(out).collect()} == batch
    assert 0 < max(sizes) <= 4 * 4


def test_lines_keep_no_value_for_each_job(spark):
    """The workers' lines of many jobs, in the same few values as the other events."""
    puts = news(spark, *((f"j{k}", 1, 0, "put", "queued", 0) for k in range(200))).withColumn("line", F.lit(None).cast("string"))
    lines = news(spark, *((f"j{k}", 2, 1, "progress", "running", None) for k in range(200))).withColumn("line", F.concat(F.lit('{"done": '), F.substring("job_id", 2, 9), F.lit(', "total": 200}')))
    sizes: list[int] = []
    stream = lambda r: live.job_state_of_lines(r.filter("line IS NULL"), r.filter("line IS NOT NULL"), keep_idle_ms=10**12, keep_terminal_ms=10**12, buckets=4)
    out = fed([puts.unionByName(lines)], stream, "few-lines", "update", lambda r: sizes.append(state_rows(r)))
    assert {r.job_id: r.progress for r in Q.last_snapshots(out).collect()} == {f"j{k}": round(k / 200 * 55) for k in range(200)}
    assert 0 < max(sizes) <= 4 * 4


def test_state_partitions_follow_the_cluster(spark):
    """A session with many shuffle partitions, as for large tables: the stream's state has two a core or 16, and the session keeps its own number."""
    events = [(f"j{k}", s, k, "progress" if s < 3 or k % 2 else "cancel", "running", s) for k in range(200) for s in (1, 2, 3)]
    name, reports = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(name)
    spark.conf.set(name, "64")
    try:
        out = fed([news(spark, *[e for e in events if e[1] < 3]), news(spark, *[e for e in events if e[1] == 3])], lambda e: live.job_state_stream(e, keep_idle_ms=10**12, keep_terminal_ms=10**12, late="400 hours"), "wide", "update", reports.extend)
        assert spark.conf.get(name) == "64"
    finally:
        spark.conf.set(name, before)
    assert {o["numShufflePartitions"] for r in reports for o in r["stateOperators"]} == {max(16, 2 * spark.sparkContext.defaultParallelism)}
    batch = {r.job_id: (r.status, r.progress) for r in W.job_snapshots(news(spark, *events)).collect()}
    assert {r.job_id: (r.status, r.progress) for r in Q.last_snapshots(out).collect()} == batch


def test_rows_of_a_feed_are_made_once(spark):
    """The parts of the feed hold the rows that were given, in the order of time, and run none of their windows and joins again."""
    events = news(spark, *((f"j{k % 7}", 0, k, "progress", "running", k) for k in range(40))).drop("seq")
    rows = events.withColumn("seq", F.row_number().over(W.Window.partitionBy("job_id").orderBy("ts"))).join(events.select("job_id", "ts"), ["job_id", "ts"])
    parts = Q.in_parts(rows, "ts", 4)
    assert [sorted(r.progress for r in p.collect()) for p in parts] == [list(range(10 * k, 10 * k + 10)) for k in range(4)]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted((tuple(r) for p in parts for r in p.select(rows.columns).collect()), key=str)
    plans = [p._jdf.queryExecution().optimizedPlan().toString() for p in parts]
    assert not any("Window" in plan or "Join" in plan for plan in plans)


def test_events_with_lines_take_one_shuffle(spark, tmp_path):
    """Each event meets all events of its job and time, as in the SQL's join, null ids and times not; the plan has a window, one exchange and no join."""
    at = lambda m: None if m is None else dt.datetime(2024, 1, 1, 0, m)
    rows = [(k, at(m), user, kind, 5.0) for k, (m, user, kind) in enumerate([(0, 1, "click"), (0, 1, "purchase"), (0, 2, "click"), (1, 1, "error"), (None, 1, "click"), (1, None, "click"), (2, 2, "signup"), (2, 2, "view"), (2, 2, "click")])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"file://{tmp_path}/events.parquet")
    found = Q.lined_events(spark, f"file://{tmp_path}")
    view = lambda name: Q.view(spark, f"file://{tmp_path}", name)
    joined = view("v_job_events").join(view("events").select(F.col("user_id").cast("string").alias("job_id"), "ts", "event_id"), ["job_id", "ts"])
    columns = ["job_id", "seq", "ts", "kind", "status", "stage", "progress"]
    assert found.count() == 2 * 2 + 1 + 1 + 3 * 3
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, joined.select(columns).collect()))
    assert {r.line for r in found.filter("job_id = 1 AND seq = 2").collect()} == {"size=12", '{"done":1,"total":64}'}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_events_are_packed_by_bucket(spark, tmp_path):
    """The state gets one row of lists for each bucket of a task's events, whatever their number; none is lost, and lines are read in one scan."""
    events = news(spark, *((f"j{k}", k, k, "progress" if k % 3 else "cancel", None if k % 5 == 0 else "running", None if k % 7 == 0 else k) for k in range(1000))).coalesce(1)
    told = events.select("job_id", "seq", "kind", "status", "stage", "progress", F.unix_micros("ts").alias("us"), (F.col("seq") % 3).cast("int").alias("bucket"))
    packs = told.mapInArrow(live.pack, live.PACK)
    rows = packs.collect()
    assert sorted(r.bucket for r in rows) == [0, 1, 2] and all(len(r[c]) == len(r.seq) for r in rows for c in live.NEWS)
    assert sorted((x for r in rows for x in zip(*(r[c] for c in live.NEWS), strict=True)), key=str) == sorted((tuple(r) for r in told.select(live.NEWS).collect()), key=str)
    assert packs.filter("unix_micros(ts) <> array_max(us)").count() == 0
    stream = live.job_state_of_lines(spark.readStream.schema(JOBS + ", line string").parquet(f"file://{tmp_path}"))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("StreamingRelation") == 1 and "Union" not in plan


def test_late_events_of_a_pack_go_alone(spark):
    """One bucket, so late and timely events share a row; only the late ones go. Times are kept to the microsecond."""
    parts = [
        news(spark, ("a", 1, 0, "put", "running", 1), ("b", 1, 10, "put", "running", 1)),  # the watermark comes to 9 hours
        news(spark, ("a", 2, 9, "progress", "running", 2), ("b", 2, 9, "progress", "running", 2), ("b", 3, 11, "progress", "running", 3), ("c", 1, 1, "put", "running", 9)).unionByName(
            news(spark, ("d", 1, 9, "put", "running", 4)).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MICROSECOND"))
        ),
    ]
    out = fed([p.coalesce(1) for p in parts], lambda e: live.job_state_stream(e, late="1 hour", keep_idle_ms=10**12, keep_terminal_ms=10**12, buckets=1), "late-pack", "update")
    assert sorted((r.job_id, r.seq, r.progress) for r in out.collect()) == [("a", 1, 1), ("b", 1, 1), ("b", 3, 3), ("d", 1, 4)]


def test_fold_by_columns_is_the_plain_fold():
    draw = random.Random(7)
    for n in range(400):
        jobs = draw.randint(1, 5)
        events = [(draw.randrange(jobs), draw.randint(1, 6 if n % 2 else 10**6), draw.choice(["put", "progress", "cancel"]), draw.choice(["running", None, "failed", "succeeded", "cancelled"]), draw.choice(["a", None]), draw.choice([None, 1, 50])) for _ in range(draw.randint(1, 20))]
        before = [draw.choice([None, (draw.randint(0, 4), draw.choice(["running", "failed", "cancelled", None]), "s", draw.choice([None, 7]))]) for _ in range(jobs)]
        want = {}
        for job, state in enumerate(before):
            for _, *event in sorted((e for e in events if e[0] == job), key=lambda e: e[1]):
                state = live.fold(state, *event)
            if state != before[job]:
                want[job] = state
        code, seq, *texts, progress = (np.array(c, t) for c, t in zip(zip(*events, strict=True), (int, np.int64, object, object, object, object), strict=True))
        assert dict(live.folded(before, code, seq, *texts, progress)) == want
