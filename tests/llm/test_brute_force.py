"""Operators that SQL can't express, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cuelake.llm import bpe, fingerprints, html_text, jaccard, langid, media, mixing, pii, quality, queries, repeats
from cuelake.llm.common import bucket_of

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- repeats ----------------------------------------------------------------------------------

def covered(texts: list[bytes], width: int) -> list[bytearray]:
    places = Counter(t[s : s + width] for t in texts for s in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if places[t[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        out.append(gone)
    return out


def plain_repeats(texts: list[bytes]):
    out = []
    for t, gone, passage in zip(texts, covered(texts, repeats.WIDTH), covered(texts, repeats.PASSAGE), strict=True):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        found = sum(len(t[m.start() : m.end()].split()) > repeats.PASSAGE_WORDS for m in re.finditer(b"\1+", bytes(passage)))
        out.append((len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest(), found))
    return out


def planted(seed: int) -> list[str]:
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, family = text(700), text(1500)
    out = [text(rng.randint(0, 900)) for _ in range(6)] + ["ab" * 700, "x" * 900, passage + passage, family, family]
    out += [text(rng.randint(0, 300)) + passage[rng.randint(0, 200) : 650] + text(rng.randint(0, 300)) for _ in range(8)]
    for _ in range(12):
        at = rng.randint(0, 1400)
        out.append(family[:at] + text(rng.randint(1, 5)) + family[at:])
    return out


@pytest.mark.parametrize("most", [2, 5, 16384])
def test_repeats(spark, monkeypatch, most):
    """Also with parts so small that grams are split down to single windows."""
    monkeypatch.setattr(repeats, "GROUP_MOST", most)
    texts = planted(most)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages) for r in repeats.remove_repeats(df).collect()}
    assert [got[k] for k in range(len(texts))] == plain_repeats([t.encode() for t in texts])


@pytest.mark.parametrize("most", [3, 16384])
def test_nothing_goes_without_the_suffix_order(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "GROUP_MOST", most)
    df = spark.createDataFrame(list(enumerate(planted(1))), "doc_id long, text string")
    assert sum(r.n_removed for r in repeats.remove_repeats(df).collect())

    def without(batches):
        """sort_groups, but with no order of suffixes."""
        from cuelake.llm import repeats as own

        order, own.suffix_order = own.suffix_order, lambda strings: []
        try:
            yield from own.sort_groups(batches)
        finally:
            own.suffix_order = order

    monkeypatch.setattr(repeats, "sort_groups", without)
    assert {(r.n_removed, r.n_passages) for r in repeats.remove_repeats(df).collect()} == {(0, 0)}


@pytest.mark.parametrize("seed", range(20))
def test_suffix_order(seed):
    rng = random.Random(seed)
    stem = bytes(rng.choice(b"ab") for _ in range(150))
    strings = [stem[: rng.randint(0, 150)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 60))]
    assert [strings[k] for k in repeats.suffix_order(strings, shallow=rng.choice([1, 8, 96]))] == sorted(strings)


# --- Jaccard ----------------------------------------------------------------------------------

def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = set() if not w else ({tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed: int):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    doc = lambda n: [rng.choice(words) for _ in range(n)]
    passage, out = doc(40), []
    for _ in range(6):
        base = doc(rng.randint(60, 160))
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 22))):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(own)
    out += [doc(60) + passage + doc(20) for _ in range(25)] + [doc(rng.randint(0, 6)) for _ in range(10)] + [out[0], out[20], passage, passage + doc(3)]
    rng.shuffle(out)
    return [(k, " ".join(w).title() if k % 3 else " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize(("block", "kept"), [(1024, 200_000), (8, 200_000), (8, 0), (5, 40)])
def test_components(spark, monkeypatch, block, kept):
    """Also with tiny trees, so that groups have many, and without the order by frequency."""
    for k, v in {"BLOCK_ROWS": block, "FANOUT": 3, "GROUP_ROWS": 7, "COMMON_KEPT": max(kept, 1)}.items():
        monkeypatch.setattr(jaccard, k, v)
    rows = families(block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == plain_components(rows)


def test_all_links_come_through_the_trees(spark, monkeypatch):
    """Every class that has a link is a leaf; without what the trees find there is none."""
    stages = defaultdict(list)

    def written(df, name, own=jaccard.written):
        stages[name].append(own(df, name))
        return stages[name][-1]

    monkeypatch.setattr(jaccard, "written", written)
    monkeypatch.setattr(jaccard, "discard", lambda *tables: None)
    rows = families(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    sets = {i: jaccard.class_of(jaccard.shingle_set(t.encode())) for i, t in rows}
    sizes = Counter(got.values())
    linked = {sets[i] for i in got if sizes[got[i]] > 1 and len({sets[j] for j in got if got[j] == got[i]}) > 1}
    assert linked and linked <= {r.cls for r in stages["jaccard-leaves"][0].select("cls").collect()}
    found = {tuple(sorted((r.a, r.b))) for name in ("jaccard-stars", "jaccard-pairs") for r in stages[name][0].collect()}
    assert {tuple(sorted((r.a, r.b))) for links in stages["jaccard-links"] for r in links.collect()} <= found
    empty = spark.createDataFrame([], "a long, b long, weight long")
    monkeypatch.setattr(jaccard, "written", lambda df, name, own=stages["jaccard-leaves"].__class__: df)
    monkeypatch.setattr(jaccard, "leader_pairs", lambda leaves: empty.select("a", "b"))
    monkeypatch.setattr(jaccard, "open_pairs", lambda leaves, labels: empty.select("a", "b"))
    apart = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    worded = [i for i, t in rows if t.split()]
    assert [apart[i] for i in worded] == [min(j for j in worded if sets[j] == sets[i]) for i in worded]


def test_components_of_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_jaccard(spark, SF).collect()}
    assert got == plain_components(rows)


# --- PII --------------------------------------------------------------------------------------

def plain_pii(t: str):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


def test_pii(spark):
    rng, finder = random.Random(1), pii.Finder()
    for _ in range(5000):
        t = "".join(rng.choice("0011299.. -+@ab(). 4111111111111111") for _ in range(rng.randint(0, 40)))
        assert [s for s in finder.spans(t) if s[1] < pii.BASE] == plain_pii(t)
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in queries.op3_pii(spark, SF).collect():
        plain = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.listed(plain).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in plain) for k in range(4))
    assert finder.redact("mail bob@x.com, +1 (212) 555-0100 at 12 Main Street. IBAN DE89370400440532013000 http://a.b/c. TOKEN = \"9233A8ECF7C5B09FE594\" token: none") == "mail <EMAIL>, <PHONE> at <ADDRESS>. IBAN <ACCOUNT> <URL>. TOKEN = \"<SECRET>\" token: none"


# --- mixing -----------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(30))
def test_apportionment(seed):
    rng = random.Random(seed)
    votes = [float(rng.randint(0, 50)) for _ in range(rng.randint(1, 9))]
    most = [rng.randint(0, 30) for _ in votes]
    seats, got = rng.randint(0, 60), [0] * len(votes)
    for _ in range(min(seats, sum(most)) if sum(votes) else 0):
        k = max((k for k in range(len(votes)) if got[k] < most[k]), key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
        got[k] += 1
    assert mixing.sainte_lague(votes, seats, most) == got


def test_mix(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    rows = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()))
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert target == pytest.approx(plain_targets(size))
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in size)
    mixed = Counter()
    for r in mixing.mixed_texts(docs).select("doc_id", "text").collect():
        mixed[r.doc_id] += len(re.findall(mixing.WORD, r.text))
    assert mixed == Counter({r.doc_id: r.taken for r in rows if r.taken})


def plain_targets(size: dict) -> dict:
    """The common level of words a weight at which all targets, each cut at three times its source, add up to all words, by bisection."""
    ordered = sorted(s for s in size if s is not None) + [None] * (None in size)
    low, high = 0.0, 3.0 * sum(size.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        got = {s: min(3 * size[s], level * (k % 3 + 1)) for k, s in enumerate(ordered)}
        low, high = (level, high) if sum(got.values()) < sum(size.values()) else (low, level)
    return got


@pytest.mark.parametrize("seed", range(10))
def test_targets_against_a_plain_version(seed):
    rng = random.Random(seed)
    size = {s: rng.choice([0, 1, 10, 1000, 10**6]) for s in [*(f"s{k}" for k in range(rng.randint(1, 30))), None]}
    assert mixing.targets(size, mixing.cyclic_weights(list(size))) == pytest.approx(plain_targets(size), rel=1e-6, abs=1e-3)


def test_rows_without_an_id_spread(spark):
    """Rows that share an id lie in many buckets, and reruns agree however the rows are dealt."""
    rows = [(None, f"text {k} " * (k % 7 + 1), "s") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mixing.mix_sources(d, docs_per_shard=10).collect()), key=repr) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 300
    plan = mixing.block_plan(df, "doc_id", "text", "source", keep=False, docs_per_shard=10)
    assert plan.filter("start = 0").count() > 10  # the first rows of so many shards


def test_targets_stop_at_three_times_the_source():
    got = mixing.targets({"a": 10, "b": 1000, "c": 1000}, {"a": 1, "b": 2, "c": 3})
    assert got["a"] == 30 and got["b"] == pytest.approx(1980 * 2 / 5) and got["c"] == pytest.approx(1980 * 3 / 5)


# --- BPE --------------------------------------------------------------------------------------

ODD = ["", "a", "<|endoftext|>", "x <|endoftext|><|endoftext|> y", "   x\x1c y\x85\x1f ​", "don't we'll  I'M  \n\n \t x", "漢字かな 🎉🎉👩‍👩‍👧 ß", "a" * 5000, "ab" * 300 + " " * 400, "١٢٣ ½ ⅷ", "﻿x y", "a   b", "a\n \nb", " a", " \n a  ", "a \nb", "a  b"]


def test_bpe(spark):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    codec = bpe.ByteLevelCodec(bpe.load_vocabulary(queries.tokenizer_path()), slots=64, pool=100)
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for text in ODD + list(texts.values())[:40]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)
    for r in queries.op7_bpe(spark, SF).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- media ------------------------------------------------------------------------------------

def test_media_round_trip(spark):
    rng = random.Random(3)
    data = [b"", b"x", rng.randbytes(5000), bytes([255]) * 1000, bytes(range(256)) * 3, b"\x00\xff" * 500]
    payloads = [media.payload_of(d) for d in data]
    assert [p for p, _, _ in media.contents_of(media.files_of(payloads), {})] == payloads
    for r in queries.op6_media(spark, SF).limit(50).join(table(spark, "documents"), "doc_id").collect():
        payload = media.payload_of((r.text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((r.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_foreign_files(spark):
    """Neither AVI nor motion JPEG, cut, empty, without frames: one row each with 0 frames; files beside them are read."""
    good = media.files_of([media.payload_of(b"x" * 500)])[0]
    bad = [b"", b"RIFF", b"no media at all", good[:100], good[: len(good) // 2], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:12], good[: good.rfind(b"idx1") - 1]]
    without_index = good[: good.rfind(b"idx1")] + bytes(64)
    df = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate([good, *bad, good, without_index])], "doc_id long, media binary")
    got = {r.doc_id: (r.clip_no, r.n_frames) for r in media.clip_rows(df).collect()}
    assert got[0] == got[len(bad) + 1] == got[len(bad) + 2] == (0, 3)
    assert all(got[k] == (None, 0) for k in range(1, len(bad) + 1))


def plain_shots(frames: list[bytes]) -> list[int]:
    """First frames of shots: the change of 16-bin histograms against the mean and deviation of the changes nearby."""
    bins = [Counter(v >> 4 for v in f) for f in frames]
    change = [0] + [sum(abs(a[k] - b[k]) for k in range(16)) for a, b in zip(bins, bins[1:])]
    out = [0]
    for k in range(1, len(frames)):
        near = change[max(1, k - media.NEIGHBOURS) : k + media.NEIGHBOURS + 1]
        mean = sum(near) / len(near)
        deviation = max(0, sum(c * c for c in near) / len(near) - mean * mean) ** 0.5
        if change[k] > mean + media.DEVIATIONS * deviation and change[k] >= media.LEAST_DIFFERENCE:
            out.append(k)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_shots_against_the_rule(seed):
    rng = random.Random(seed)
    payloads = [b"".join(bytes(rng.randrange(lo, lo + 40) for _ in range(192)) for lo in [rng.choice([30, 90, 180]) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 25))) for _ in range(4)]
    for payload, (_, shots, _) in zip(payloads, media.contents_of(media.files_of(payloads), {}), strict=True):
        assert shots == plain_shots([payload[k : k + 192] for k in range(0, len(payload), 192)])


def test_shots(spark):
    cut = b"aaaaaaaaaaaa" * 16 * 20 + bytes(range(200, 248)) * 4 * 20
    starts = list(media.contents_of(media.files_of([cut]), {}))[0][1]
    assert starts == [0, 20]
    df = spark.createDataFrame([(1, cut.decode("latin-1")[: 192 * 20])], "doc_id long, text string")
    rows = media.clip_rows(media.store_media(df)).collect()
    assert [(r.clip_no, r.start_s, r.n_frames) for r in rows] == [(0, 0.0, 20)] and rows[0].end_s == pytest.approx(0.8)


# --- models -----------------------------------------------------------------------------------

def test_language_held_out(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in docs.filter(bucket_of("doc_id", 4) == 2).join(spark.createDataFrame(got), "doc_id").select("held_out").collect())


def test_quality_held_out(spark):
    docs, labels = (table(spark, n, "/root/testdata/sf0.01") for n in ("documents", "labels"))
    got = quality.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95 and sum(r.predicted == 1 for r in got if r.quality == 1) >= 0.95 * len(good)


# --- fingerprints -----------------------------------------------------------------------------

def plain_digest(data: bytes) -> str:
    """The digest by its description, byte triplet by byte triplet."""
    counts = [0] * 128
    for k in range(len(data) - 2):
        counts[((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 2654435761 % (1 << 32)) >> 25] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (31, 63, 95))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    head = [min(255, round(math.log(len(data) + 1, 1.2))), q1 * 15 // max(q3, 1) << 4 | q2 * 15 // max(q3, 1)]
    return bytes(head + [codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, 128, 4)]).hex()


def test_digest():
    rng = random.Random(2)
    for data in [b"", b"a", b"abc", b"a" * 900, *(rng.randbytes(rng.randint(0, 3000)) for _ in range(20)), *("".join(rng.choice("the and of ") for _ in range(2000)).encode() for _ in range(3))]:
        assert fingerprints.digest(data)[1] == plain_digest(data)


def test_fingerprints(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    near = defaultdict(list)
    for r in queries.op9_fingerprints(spark, SF).collect():
        text, nxt = docs[r.doc_id], docs[after[r.doc_id]]
        edited = text[: len(text) - len(text) // 3] + nxt[: len(text) // 3]
        prints = [fingerprints.digest(t.encode())[1] for t in (text, edited, nxt)]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2])
        a, e, n = map(fingerprints.parse, prints)
        assert r.near_edited == pytest.approx(fingerprints.likeness(a, e)) and r.near_next == pytest.approx(fingerprints.likeness(a, n))
        near["edited"].append(r.near_edited)
        near["next"].append(r.near_next)
    assert sum(near["edited"]) > 1.5 * sum(near["next"])


# --- HTML -------------------------------------------------------------------------------------

def test_html_of_the_tables(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents", "/root/testdata/sf0.01").collect()}
    pages = table(spark, "pages", "/root/testdata/sf0.01").withColumn("of", F.regexp_extract("url", r"/[a-z]{2}/(\d+)", 1).cast("long")).collect()
    assert len(pages) > 100
    for p in pages:
        lines = [x for x in (" ".join(line.split()) for line in docs[p.of].split("\n")) if x]
        assert html_text.main_text(p.html).split("\n")[1:] == lines


def test_html_shapes():
    assert html_text.main_text('<div class=header>x</div><div id="main"><h2>T</h2><p>Hello, <a href=x>world</a>. This is text, with marks.</p><ul><li>One item, here.<li>Two</ul><p>More&nbsp;text &lt;b&gt; here, ok.</div><div class="comments"><p>bad, comment. yes</div><aside>q</aside>') == "T\nHello, world. This is text, with marks.\nOne item, here.\nTwo\nMore text <b> here, ok."
    page = "<body><nav><a href=a>Home</a></nav><div class='cookie-notice'>We use cookies, ok.</div><article><p>First, one.<br>Same block.<p>Second: two.<table><tr><td>cell, a<td>cell, b</table></article><div class='related'><a href=b>more, more.</a></div><form>Name, mail: <input></form><script>var x = '<p>no</p>';</script><footer>(c) us, 2020.</footer>"
    assert html_text.main_text(page) == "First, one. Same block.\nSecond: two.\ncell, a\ncell, b"
