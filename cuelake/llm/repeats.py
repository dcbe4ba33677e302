"""Removal of repeated byte strings by sorting suffixes (deep-shallow).

A byte goes if a string of WIDTH bytes that covers it starts at two places at least, in one or
several documents. Strings of PASSAGE bytes are found along with these, for the passages that documents
share. Sorting all suffixes of a corpus isn't needed for that: every window of PASSAGE
bytes picks an anchor, the place of the least hash of its GRAM-byte grams (leftmost on ties), so
equal windows have anchors at the same offset. Only anchors whose gram comes again are looked at.

- Anchors with one gram and one neighbourhood (all windows of WIDTH bytes over the gram) are one entry with a count,
  before any text moves.
- The neighbourhoods of one gram are sorted: the suffixes from the anchor on, and the
  reversed prefixes before it, by multikey quicksort to a shallow depth; groups that agree so far
  are ordered by a blind trie. Clusters of suffixes are then joined by descending common prefix,
  and each joined neighbourhood is compared with its two neighbours in prefix order: the longest
  common prefix on both sides says which windows the two share. An entry that stands for several places is sorted
  twice, so that the order finds these, too. So each entry gets how far its repeats reach to either side of the anchor, and
  all places with that entry have the same.
- A gram with more than GROUP_MOST neighbourhoods is split further by the suffix order before it is sorted: some adjoining
  windows have a string in common, and only neighbourhoods that agree in it can share one of them. What such a part
  has of a neighbourhood is clipped to these windows, and equal clips are one entry. Parts of
  more than GROUP_MOST clips are split once more, down to single windows, where a part has one clip.

Rows are told apart by their id and 16 bits of a hash of their text, so that rows may share an id. Positions
have 30 bits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, discard, mapped, mix64, packed, powers, unpack_text, written

WIDTH = 400
#: Passages: repeated strings of so many bytes at least that hold more than so many words.
PASSAGE = 300
PASSAGE_WORDS = 50
GRAM = 64
GROUP_MOST = 16384
#: Adjoining windows in a part of a large gram, level by level.
STEPS = (120, 24, 5, 1)
SHALLOW = 96
#: Bytes that the quicksort compares at once.
STRIDE = 8
STEP_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of all windows of some texts set side by side; none where a text is shorter than a window."""
    n = len(data)
    if n < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = data.astype(np.uint64) + np.uint64(1)
    size, factor = 1, _MULTIPLIER
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    h = mix64(h)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, size = width - gram + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: size - span], low[span - size :])
    edge = np.zeros(n + 1, dtype=np.int64)  # windows that lie in one text
    long = ends - starts >= width
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - width + 1, -1)
    at = (low[np.cumsum(edge[: len(low)]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if len(at):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """A Patricia trie: a node holds the depth where its strings part, and a child for each byte there (-1: the end)."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: object = None

    def byte(self, k: int, depth: int) -> int:
        s = self.strings[k]
        return s[depth] if depth < len(s) else -1

    def add(self, k: int) -> None:
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, tuple):  # blindly to a leaf: bytes between the branching ones aren't looked at
            depth, children = node
            node = children.get(self.byte(k, depth)) or next(iter(children.values()))
        other = node[0]
        depth = common_prefix(self.strings[k], self.strings[other])
        if depth == len(self.strings[k]) == len(self.strings[other]):
            node.append(k)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][self.byte(k, node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self.byte(k, depth)] = [k]
            return
        fresh = (depth, {self.byte(other, depth): node, self.byte(k, depth): [k]})
        if above is None:
            self.root = fresh
        else:
            above[1][self.byte(k, above[0])] = fresh

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            elif node:
                out += node
        return out


def suffix_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of strings: multikey quicksort by STRIDE bytes at once to the shallow depth, then a blind trie for each group left."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
            continue
        if depth >= shallow:
            trie = BlindTrie(strings)
            for k in group:
                trie.add(k)
            out += trie.order()
            continue
        keys = [strings[k][depth : depth + STRIDE] for k in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        same = [k for k, c in zip(group, keys, strict=True) if c == pivot]
        if len(same) == len(group):
            if len(pivot) < STRIDE:  # all ended here: equal strings
                out += same
            else:  # nothing parts here: go on where something may
                base = strings[group[0]]
                stack.append((same, min(common_prefix(base, strings[k]) for k in group[1:])))
            continue
        less = [k for k, c in zip(group, keys, strict=True) if c < pivot]
        more = [k for k, c in zip(group, keys, strict=True) if c > pivot]
        stack += [(more, depth), (same, depth + STRIDE), (less, depth)]
    return out


def reaches(left: list[bytes], right: list[bytes], widths: tuple[int, ...] = (PASSAGE, WIDTH)) -> np.ndarray:
    """For each neighbourhood and width how many bytes before and from the anchor on its shared windows of that width cover.

    left holds the reversed prefixes. All these windows hold the anchor, so two numbers say it; -1: none.
    """
    out = np.full((len(left), len(widths), 2), -1, dtype=np.int64)

    def note(k: int, l: int, r: int) -> None:
        for w, width in enumerate(widths):
            if l + r >= width:
                own = out[k, w]
                own[0], own[1] = max(own[0], l), max(own[1], r)

    if len(left) < 2:
        return out
    by_right = suffix_order(right)
    at_rank = suffix_order(left)
    rank = [0] * len(left)
    for place, k in enumerate(at_rank):
        rank[k] = place
    steps = sorted(((common_prefix(right[a], right[b]), i) for i, (a, b) in enumerate(zip(by_right, by_right[1:], strict=False))), reverse=True)
    cluster: list[list[int]] = [[rank[k]] for k in by_right]
    owner = list(range(len(by_right)))
    longest = max(map(len, left))

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for r, i in steps:
        if r + longest < widths[0]:
            break
        a, b = find(i), find(i + 1)
        if len(cluster[a]) < len(cluster[b]):
            a, b = b, a
        large = cluster[a]
        for place in cluster[b]:
            x = at_rank[place]
            p = bisect_left(large, place)
            for q in (p - 1, p):
                if 0 <= q < len(large):
                    y = at_rank[large[q]]
                    l = common_prefix(left[x], left[y])
                    if l + r >= widths[0]:
                        note(x, l, r)
                        note(y, l, r)
            large.insert(p, place)
        owner[b], cluster[b] = a, []
    return out


#: An anchor's place in one integer: 16 bits of the hash of the text, bytes before and after it in its neighbourhood, position.
BEFORE, AFTER, OWN = 39, 30, 48


def find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, place, gram, whole): whole is a hash of the neighbourhood; with the gram's hash it has 128 bits."""
    for batch in batches:
        raw = [as_bytes(t) for t in batch["text"]]
        keys, th = batch["doc_id"].to_numpy(), batch["th"].to_numpy(dtype=np.int64)
        start = 0
        while start < len(raw):
            end, held = start, 0
            while end < len(raw) and (end == start or held + len(raw[end]) <= STEP_BYTES):
                held += len(raw[end])
                end += 1
            data = np.frombuffer(b"".join(raw[start:end]), dtype=np.uint8)
            ends = np.cumsum([len(r) for r in raw[start:end]])
            starts = np.concatenate([[0], ends[:-1]])
            at, gram = anchors(data, starts, ends)
            if len(at):
                doc = np.searchsorted(ends, at, side="right")
                before, after = np.minimum(at - starts[doc], WIDTH - GRAM), np.minimum(ends[doc] - at, WIDTH)
                up, down = powers(len(data) + 1)
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), ((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]).cumsum(dtype=np.uint64)])
                whole = mix64((sums[at + after] - sums[at - before]) * down[at - before] + (before * 512 + after).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                place = (th[start + doc] << OWN) | (before << BEFORE) | (after << AFTER) | (at - starts[doc])
                yield pd.DataFrame({"doc_id": keys[start + doc], "place": place, "gram": gram.astype(np.int64), "whole": whole.astype(np.int64)})
            start = end


def unpacked(place: str = "place") -> dict:
    """The parts of a place as columns."""
    bits = lambda shift, n: F.shiftrightunsigned(place, shift).bitwiseAND((1 << n) - 1)
    return {"th": bits(OWN, 16), "before": bits(BEFORE, 9), "after": bits(AFTER, 9), "pos": F.col(place).bitwiseAND((1 << AFTER) - 1)}


CUT = "gram long, whole long, several boolean, many boolean, left binary, right binary"


def cut_neighbourhoods(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CUT.split(", ")]
    for batch in batches:
        rows = []
        for text, wanted in zip(batch["packed"], batch["wanted"], strict=True):
            data = unpack_text(text)
            for w in wanted:
                at = w["pos"]
                rows.append((w["gram"], w["whole"], w["several"], w["many"], data[at - w["before"] : at], data[at : at + w["after"]]))
                if len(rows) == 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)


REACH = "gram long, part long, whole long, p_left long, p_right long, left long, right long"
_REACH = [c.split()[0] for c in REACH.split(", ")]


def sort_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by gram and part: the reach of each neighbourhood. Parts have GROUP_MOST rows at most, and are held together."""
    held: list[tuple] = []
    out: list[tuple] = []

    def solve() -> None:
        places = [h for h in held for _ in range(1 + bool(h[1]))]  # two of several places
        found = reaches([h[2][::-1] for h in places], [h[3] for h in places])
        for k in np.flatnonzero(found[:, 0, 0] >= 0).tolist():
            out.append((*gram, places[k][0], *found[k].ravel().tolist()))

    gram = None
    for batch in batches:
        for own, part, *row in batch[["gram", "part", "whole", "several", "left", "right"]].itertuples(index=False, name=None):
            if (own, part) != gram:
                if held:
                    solve()
                held, gram = [], (own, part)
            held.append(row)
        if out:
            yield pd.DataFrame(out, columns=_REACH)
            out.clear()
    if held:
        solve()
    if out:
        yield pd.DataFrame(out, columns=_REACH)


PARTS = "gram long, part long, clip long, whole long, several boolean, width int, low int, high int"


def list_parts(step: int):
    """For each neighbourhood and `step` adjoining windows, told by the anchor's distance from their beginning: a hash of what the windows have in common, and one of all that they cover."""
    names = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                rows = []
                for gram, whole, several, left, right, width, low, high in batch[["gram", "whole", "several", "left", "right", "width", "low", "high"]].iloc[start : start + 1000].itertuples(index=False, name=None):
                    data, at = left + right, len(left)
                    for first in range(low, high + 1, step):
                        last = min(first + step - 1, high)
                        if max(first, width - len(right)) <= min(last, at):
                            common = xxhash.xxh3_64_intdigest(data[at - first : at - last + width], width * 1000 + first) - (1 << 63)
                            before = min(at, last)
                            clip = xxhash.xxh3_64_intdigest(data[at - before : at - first + width], before) - (1 << 63)
                            rows.append((gram, common, clip, whole, several, width, first, last))
                yield pd.DataFrame(rows, columns=names)

    return run


def merge_spans(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def cut_spans(data: bytes, spans: list[list[int]]) -> bytes:
    at, parts = 0, []
    for low, high in spans:
        parts.append(data[at:low])
        at = high
    return b"".join([*parts, data[at:]])


def own_hash(text_col: str = "text"):
    return F.pmod(F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)), F.lit(1 << 16)).cast("int")


def sorted_parts(rows: DataFrame) -> DataFrame:
    return mapped(rows.repartition("gram", "part").sortWithinPartitions("gram", "part"), sort_groups, REACH)


def reach_of_large(many: DataFrame) -> DataFrame:
    """The reach of the neighbourhoods of grams that have more than GROUP_MOST of them."""
    rows = many.withColumn("width", F.explode(F.array(F.lit(PASSAGE), F.lit(WIDTH)))).withColumn("low", F.lit(0)).withColumn("high", F.col("width") - GRAM)
    found: list[DataFrame] = []
    for step in STEPS:
        parts = written(mapped(rows.select("gram", "whole", "several", "left", "right", "width", "low", "high"), list_parts(step), PARTS), "repeats-parts")
        clips = written(parts.groupBy("gram", "part", "clip").agg(F.count("*").alias("n"), F.max("several").alias("several"), F.min("whole").alias("whole"), *[F.max(c).alias(c) for c in ("width", "low", "high")]), "repeats-clips")
        sizes = written(clips.groupBy("gram", "part").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max("several").alias("several")).filter("n > 1 OR several").select("gram", "part", "kinds"), "repeats-sizes")
        texts = clips.join(sizes.filter(F.col("kinds") <= GROUP_MOST), ["gram", "part"]).withColumn("several", F.col("several") | (F.col("n") > 1)).drop("n").join(many.select("gram", "whole", "left", "right"), ["gram", "whole"])
        left = F.expr("substring(left, greatest(length(left) - high, 0) + 1, high)")
        right = F.expr("substring(right, 1, width - low)")
        reach = written(sorted_parts(texts.select("gram", "part", F.col("clip").alias("whole"), "several", left.alias("left"), right.alias("right"))), "repeats-clip-reach")
        found.append(parts.join(reach.withColumnRenamed("whole", "clip"), ["gram", "part", "clip"]).select(*_REACH))
        large = sizes.filter(F.col("kinds") > GROUP_MOST)
        if large.isEmpty():
            break
        rows = parts.join(large, ["gram", "part"]).select("gram", "whole", "width", "low", "high").join(many, ["gram", "whole"])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, p_left, p_right, left, right): how far around pos the repeats of PASSAGE and of WIDTH bytes reach, -1 for none; docs holds doc_id, th, text."""
    kind = dict(docs.dtypes)["doc_id"]
    found = written(mapped(docs, find_anchors, f"doc_id {kind}, place long, gram long, whole long"), "repeats-anchors")
    again = written(found.groupBy("gram").agg(F.count("*").alias("places")).filter("places > 1").select("gram"), "repeats-again")
    twice = written(found.join(again, "gram"), "repeats-twice")
    discard(found, again)
    contexts = written(twice.groupBy("gram", "whole").agg(F.count("*").alias("places"), F.first("doc_id").alias("doc_id"), F.first("place").alias("place")), "repeats-contexts")
    large = written(contexts.groupBy("gram").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > GROUP_MOST), "repeats-large")

    # the distinct neighbourhoods, each from the first document that has it
    parts = unpacked()
    member = F.struct(parts["pos"].alias("pos"), parts["before"].alias("before"), parts["after"].alias("after"), "gram", "whole", (F.col("places") > 1).alias("several"), F.col("kinds").isNotNull().alias("many"))
    wanted = contexts.join(large, "gram", "left").select("doc_id", parts["th"].alias("th"), member.alias("w"))
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list("w").alias("wanted"))  # no more than the anchors of one document
    wanted = wanted.select(F.col("doc_id").alias("own"), F.col("th").alias("own_th"), "wanted")
    texts = packed(docs, ["doc_id", "th"])
    rows = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("own")) & (texts["th"] == F.col("own_th"))).select("packed", "wanted")
    cut = written(mapped(rows, cut_neighbourhoods, CUT).dropDuplicates(["gram", "whole"]), "repeats-cut")  # rows may agree in id and text
    discard(contexts, large)

    reach = sorted_parts(cut.filter("NOT many").select("gram", F.lit(0).cast("long").alias("part"), "whole", "several", "left", "right"))
    many = cut.filter("many")
    if not many.isEmpty():
        reach = reach.unionByName(reach_of_large(many))
    reach = written(reach.groupBy("gram", "whole").agg(*[F.max(c).alias(c) for c in _REACH[3:]]).filter("p_left >= 0"), "repeats-reach")
    discard(cut)
    return twice.join(reach, ["gram", "whole"]).select("doc_id", parts["th"].cast("int").alias("th"), parts["pos"].alias("pos"), *_REACH[3:])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_passages[, kept binary]) of every row.

    n_passages counts the maximal runs of bytes that strings of PASSAGE bytes cover which also start elsewhere, as far as a run
    holds more than PASSAGE_WORDS words; they stay. Null counts as the empty text; texts shorter than a window lose nothing; of repeated rows
    each is a repeat of the others. An empty table gives an empty result. Whole texts are read in
    two passes and shuffled twice, once to cut the neighbourhoods and once to remove the spans.
    """
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("doc_id"), own_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    per_doc = repeated_spans(docs).groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", *_REACH[3:])).alias("spans"))  # within one document
    per_doc = per_doc.select(F.col("doc_id").alias("own"), F.col("th").alias("own_th"), "spans")
    whole = packed(docs, ["doc_id", "th"])
    rows = whole.join(per_doc, whole["doc_id"].eqNullSafe(F.col("own")) & (whole["th"] == F.col("own_th")), "left").select("doc_id", "packed", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["packed"], batch["spans"], strict=True):
                data = unpack_text(text)
                spans = [] if spans is None else spans
                runs = merge_spans((s["pos"] - s["left"], s["pos"] + s["right"]) for s in spans if s["left"] >= 0)
                passages = merge_spans((s["pos"] - s["p_left"], s["pos"] + s["p_right"]) for s in spans)
                kept = cut_spans(data, runs)
                row = (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), sum(len(data[low:high].split()) > PASSAGE_WORDS for low, high in passages))
                out.append((*row, kept) if texts else row)
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept"][: 6 if texts else 5])
            frame.insert(0, id_col, batch["doc_id"].to_numpy())
            yield frame

    return mapped(rows, run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + (", kept binary" if texts else ""))
