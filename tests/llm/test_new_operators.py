"""Spelling variants, whitening and seed-and-extend against plain versions, and their edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import jaccard, seeds, spelling, whitening

SF = "/root/testdata/sf0.001"


# --- spelling ---------------------------------------------------------------------------------

def plain_counts(rows) -> dict[str, int]:
    counts: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows) -> dict[str, tuple]:
    counts = plain_counts(rows)
    near: dict[str, list[str]] = {w: [o for o in counts if o != w and one_edit(w, o)] for w in counts}
    form = {w: min(own, key=lambda o: (-counts[o], o)) if own else None for w, own in near.items()}
    form = {w: f if f and counts[f] >= 5 * counts[w] else None for w, f in form.items()}
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def found_variants(df) -> dict[str, tuple]:
    got = spelling.spelling_variants(df).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(out) == len(got)
    return out


def misspelt(seed: int) -> list[tuple]:
    """Words with few letters, so that many are near, in counts that make chains of forms."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "Öffnung", "x" * 300]
    pool = ["kettle"] * 900 + ["kettlee"] * 150 + ["kettleea"] * 25  # a chain
    for stem in stems:
        word, n = stem, rng.choice([5, 30, 700])
        for _ in range(4):
            pool += [word] * n
            k, n = rng.randrange(len(word)), max(1, n // rng.choice([4, 5, 6]))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abcé") + word[k:], word[:k] + rng.choice("abcé") + word[k + 1 :]])
    rng.shuffle(pool)
    texts = [" ".join(pool[k : k + 40]).replace("b", "B" if k % 3 else "b") for k in range(0, len(pool), 40)]
    return [(None if k % 17 == 0 else k, t) for k, t in enumerate([*texts, None, "", "12 -- 7"])]


@pytest.mark.parametrize("seed", range(3))
def test_spelling(spark, seed):
    rows = misspelt(seed)
    expected = plain_variants(rows)
    assert any(x[0] for x in expected.values()) and any(x[1] != (x[0] or w) for w, x in expected.items())
    assert found_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == expected


def test_spelling_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert found_variants(df) == plain_variants([(r.doc_id, r.text) for r in df.collect()])


def test_near_words_share_a_signature():
    """Each kind of edit at each place, in words with repeated letters, too."""
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcß") for _ in range(rng.randint(6, 12)))
        k = rng.randrange(len(a))
        b = rng.choice([a[:k] + a[k + 1 :], a[:k] + rng.choice("abcdé") + a[k:], a[:k] + rng.choice("abcdé") + a[k + 1 :]])
        if a == b:
            continue
        low, high = sorted((a, b), key=len)
        signed = spelling.signatures([low, high])
        left = {int(s[0]) for role, s in signed if role != spelling.LONGER}
        assert left & {int(s[1]) for role, s in signed if role != spelling.SHORTER}


def test_spelling_edges(spark):
    schema = "doc_id string, text string, word string, n int, run string, h int, id int, role int, root string"
    rows = [("a", "Variant " * 5, "w", 1, "r", 2, 3, 4, "q")] * 3 + [("b", "Varient", "w", 1, "r", 2, 3, 4, "q")] * 5 + [(None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert found_variants(df) == plain_variants([(r.doc_id, r.text) for r in df.collect()])
    assert spelling.spelling_variants(df.limit(0)).collect() == []


# --- Jaccard with text ids ---

def test_jaccard_of_text_ids(spark):
    """Ids that are texts give the components that numbers give."""
    texts = [f"one two three four five six seven eight nine ten {k // 3} a b c d e f g h i j k l m n o p q r s t" for k in range(9)] + [None, "", "other words stand here only once for all"]
    number = {f"{r.doc_id:03d}": f"{r.component_id:03d}" for r in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    rows = [(f"{k:03d}", t, k) for k, t in enumerate(texts)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id string, text string, cls int")).collect()
    assert {r.doc_id: r.component_id for r in got} == number and len(set(number.values())) < len(number)
    assert {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id string, text string, cls int")).collect()} == set(number.values())


# --- whitening --------------------------------------------------------------------------------

def check_whitening(rows, vectors: dict) -> None:
    """rows against numpy's eigenvectors; vectors: the whole numbers of each id that stays."""
    x = np.array(list(vectors.values()), dtype=float)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, own = np.linalg.eigh(centred.T @ centred / n)
    values, own = values[::-1][:4], own[:, ::-1][:, :4]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(x) * len(values)
    signs = np.ones(len(values))
    for i, v in vectors.items():
        for k, e in enumerate(values):
            r = got[i, k + 1]
            expected = (np.array(v) - sums / n) @ own[:, k] / np.sqrt(e)
            if abs(expected) > 0.1 and signs[k] == 1 and r["whitened"] * expected < 0:
                signs[k] = -1
            assert r["whitened"] * signs[k] == pytest.approx(expected, abs=1e-9)
            assert (r["n"], r["deviation"]) == (n, sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums, strict=True)))
            assert r["explained"] == pytest.approx(e / np.trace(centred.T @ centred / n), rel=1e-9)
            assert r["identity_error"] < 1e-9


def whole(v) -> list[int]:
    return [int(np.floor(256 * float(c))) for c in v]


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(whitening.whiten(df).collect(), {r.vec_id: whole(r.embedding) for r in df.collect()})


def test_whitening_edges(spark):
    """Null and unusable vectors go, copies count once in the fit, short vectors end in zeros, clashing names don't matter."""
    rng = np.random.default_rng(1)
    good = [[float(np.float32(c)) for c in rng.standard_normal(6)] for _ in range(40)]
    rows = [(k, v) for k, v in enumerate(good)] + [(100 + k, good[0]) for k in range(30)] + [(200, good[1][:4]), (201, [-0.0] * 6)]
    bad = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, x string, component int").repartition(4)
    check_whitening(whitening.whiten(df).collect(), {i: whole(v) + [0] * (6 - len(v)) for i, v in rows})
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.filter("vec_id >= 300")).collect() == []
    one = whitening.whiten(df.filter("vec_id = 3")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(k, 1, 0, 0.0, 0.0) for k in (1, 2, 3, 4)]
    none = spark.createDataFrame([(None, [1.0, 2.0]), (1 << 60 | 1, [3.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whitening.whiten(none).collect()} == {None, 1 << 60 | 1}


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_components(size):
    """Against numpy's eigenvectors; also an eigenvalue at the shift, equal eigenvalues and no variance."""
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, 2 * size))
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    for v in (a @ a.T, np.diag(np.arange(1.0, size + 1)), turn @ np.diag(np.r_[np.full(size // 2, 9.0), np.full(size - size // 2, 2.0)]) @ turn.T, np.eye(size), np.zeros((size, size))):
        values, vectors = whitening.components(v, 4)
        scale = max(1.0, np.linalg.norm(v))
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:4], atol=1e-12 * scale)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


@pytest.mark.parametrize("size", [1, 5, 40])
def test_polar(size):
    a = np.random.default_rng(size).standard_normal((size, size))
    u = whitening.polar(a)
    left, _, right = np.linalg.svd(a)
    assert np.abs(u - left @ right).max() < 1e-12


# --- seed and extend --------------------------------------------------------------------------

def plain_passages(rows) -> list[tuple]:
    last = (1, 0)
    key = lambda i: last if i is None else (0, i)
    first: dict[tuple, tuple] = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - 49):
            window = tuple(words[k : k + 50])
            first[window] = min(first.get(window, key(i)), key(i))
    out = []
    for i, words in split:
        gone = bytearray(len(words))
        for k in range(len(words) - 49):
            if first[tuple(words[k : k + 50])] < key(i):
                gone[k : k + 50] = b"\1" * 50
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def quoting(seed: int) -> list[tuple]:
    """Passages in many documents, near copies, copies, repeats within one document, ids that repeat and null ids."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(3)) for _ in range(40)] + ["é", "ß x"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, family, line = words(70), words(200), words(20)
    out = [words(rng.randint(0, 130)) for _ in range(5)] + [family, family, passage + passage, ["so"] * 130, ["so"] * 60, passage[:50], passage[:49]]
    out += [words(rng.randint(0, 60)) + passage[rng.randint(0, 10) : rng.randint(58, 70)] + words(rng.randint(0, 60)) for _ in range(14)]
    out += [words(rng.randint(20, 60)) + line + words(rng.randint(20, 60)) for _ in range(14)]
    for _ in range(14):
        own = list(family)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(own)
    rng.shuffle(out)
    ids = [rng.choice([k, k, k, k, 3, None]) for k in range(len(out))]
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(w)) for i, w in zip(ids, out, strict=True)]
    return [*rows, *rows[:3], (None, None), (900, ""), (901, " \n ")]


@pytest.mark.parametrize("seed", range(4))
def test_passages(spark, seed):
    rows = quoting(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, seeds.remove_passages(df).collect()), key=repr)
    expected = plain_passages(rows)
    assert sum(x[2] for x in expected) > 500
    assert got == expected


def test_passages_with_text_ids_and_clashing_names(spark):
    rows = [(f"d{k}", t, "a", 1, 2, 3) for k, (_, t) in enumerate(quoting(9))]
    df = spark.createDataFrame(rows, "name string, body string, doc_id string, th int, gram int, spans int")
    got = sorted(map(tuple, seeds.remove_passages(df, "name", "body").collect()), key=repr)
    assert got == plain_passages([r[:2] for r in rows])
    assert seeds.remove_passages(df.limit(0), "name", "body").collect() == []


def test_passages_of_long_texts(spark):
    """One text of 200,000 words, a copy of its middle, and ids that a double can't hold."""
    rng = random.Random(2)
    words = [str(rng.randrange(10**6)) for _ in range(200_000)]
    big = (1 << 60) + 1
    rows = [(big, " ".join(words)), (big + 1, " ".join(words[1000:90_000])), (None, " ".join(words[5:54]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in seeds.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {big: (200_000, 0), big + 1: (89_000, 89_000), None: (49, 0)}


def test_without_extension_only_whole_classes_go(spark, monkeypatch):
    """What the extension finds is not found beside it."""
    rows = [(1, " ".join(map(str, range(100)))), (2, " ".join(["x", *map(str, range(5, 90)), "y"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in seeds.remove_passages(df).collect()} == {1: 0, 2: 85}
    monkeypatch.setattr(seeds, "against_leader", lambda batches: iter(()))
    assert {r.doc_id: r.n_removed for r in seeds.remove_passages(df).collect()}[2] < 85


@pytest.mark.parametrize("seed", range(20))
def test_words_shared(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice(["a", "ab", "b"]) for _ in range(rng.randint(0, 8))] for _ in range(2))
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert seeds.words_shared(" ".join(a).encode(), " ".join(b).encode()) == same


def test_kept_words(spark):
    """The operator's own interface hands on the words that stay."""
    df = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 5000)
    for r in seeds.remove_passages(df, texts=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept.split()) == r.n_words - r.n_removed


def test_hot_seed_makes_no_pairs(spark):
    """A line of 20 words in 300 different texts: no window is shared, and nothing grows with the pairs."""
    rng = random.Random(3)
    own = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    line = own(20)
    df = spark.createDataFrame([(k, f"{own(60)} {line} {own(60)}") for k in range(300)], "doc_id long, text string")
    assert {r.n_removed for r in seeds.remove_passages(df).collect()} == {0}
    grams = defaultdict(int)
    docs = df.select("doc_id", F.xxhash64("text").alias("th"), "text")
    for r in docs.mapInArrow(seeds.find_seeds, "doc_id long, th long, place long, gram long, ctx long").collect():
        grams[r.gram] += 1
    assert sum(grams.values()) < 300 * 20
