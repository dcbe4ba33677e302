"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct five-word shingles; equal sets form a class.
Two sets with 100 * intersection >= 80 * union share k of their first n - ceil(0.8 n) + k members
under any common order, so classes meet in the groups of these leading members; k grows with the
set (1 + n div 20), and a class that shares fewer than k of a set of 0.8 n has no link and goes.
The order puts members that are common in the corpus last, which keeps passages that many
documents share out of the groups of documents that are otherwise different. Leading members with the
same classes make one group, which counts as often as it has members.

Every group is a set of signature trees, of BLOCK_ROWS leaves at most: nodes hold the OR of 1024-bit
token bitmaps, the range of set sizes and the component. They are searched twice, since only reachability
counts:

1. A group's leader, the class with the largest part of shared leading members, goes down each of
   its trees; nodes that can't overlap enough are left out. Each class is verified with the leader that it
   meets most often. That joins a family of near copies without its pairs.
2. Groups that still hold several components get trees by size range and component. The roots of the trees say which
   pairs of trees can hold a link at all; each of these is a task of its own, where a dual traversal leaves
   out pairs of nodes whose largest possible overlap is too small or that are one component
   already. A pair of leaves that meets in several groups is given by the first of them, as far as the first
   groups of both classes, which each leaf carries, tell. The pairs that remain are compared by all of their leading
   members, of which a link shares a part that follows from the sizes, and then verified on the whole sets.

No text moves before the trees have been searched. Nothing is sampled or capped: a member not recognised
as common costs time, not links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, discard, mapped, mix64, packed, unpack_text, word_hashes, written
from .graph import components

SHINGLE = 5
PERCENT = 80
#: Leading members beyond the first common one: one more for each so many of a set.
DEPTH = 20
#: Members seen so often within one stretch of documents are counted; the most frequent are put last in the order.
COMMON_IN_STRETCH = 3
STRETCH_BYTES = 1 << 24
COMMON_KEPT = 200_000
GROUP_ROWS = 1000
BLOCK_ROWS = 1024
BITS = 1024
FANOUT = 16
#: A leaf carries so many of the groups of its class, the first ones.
FIRST_GROUPS = 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; the whole sequence where it has fewer words than a shingle."""
    _, _, words = word_hashes(np.frombuffer(data.translate(_LOWER), dtype=np.uint8))
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        return mix64((words * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - SHINGLE + 1] * _ODD[0]
    for k in range(1, SHINGLE):
        total = total + words[k : n - SHINGLE + 1 + k] * _ODD[k]
    return np.unique(mix64(total))


def class_of(members: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes()))))


def leading(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1 + n // DEPTH


def bitmap_of(members: np.ndarray) -> bytes:
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(members & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


FIRST = "cls long, n long, bitmap binary, times long"


def first_pass(batches: Iterator[pd.DataFrame], numbers: bool = True) -> Iterator[pd.DataFrame]:
    """Members of the result (doc_id, cls, n, and a bitmap where the class is new here), and as rows without an n the members common in a stretch of distinct sets. numbers: ids are whole numbers."""
    stretch: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0
    whole = {"n": "Int64", "times": "Int64"} | ({"doc_id": "Int64"} if numbers else {})

    def common() -> pd.DataFrame:
        found, times = np.unique(np.concatenate(stretch), return_counts=True)
        often = times >= COMMON_IN_STRETCH
        return pd.DataFrame({"doc_id": None, "cls": found[often].astype(np.int64), "n": None, "bitmap": None, "times": times[often]}).astype(whole)

    for batch in batches:
        rows = []
        for key, text in zip(batch["doc_id"], batch["text"], strict=True):
            data = as_bytes(text)
            members = shingle_set(data)
            cls = class_of(members)
            fresh = len(members) and cls not in seen
            rows.append((key, cls, len(members), bitmap_of(members) if fresh else None, None))
            if fresh:
                seen.add(cls)
                stretch.append(members)
                size += len(data)
                if size >= STRETCH_BYTES:
                    yield common()
                    stretch.clear()
                    seen.clear()
                    size = 0
        yield pd.DataFrame(rows, columns=["doc_id", "cls", "n", "bitmap", "times"]).astype(whole)
    if stretch:
        yield common()


def overlap_enough(shared, a, b):
    """100 * intersection >= 80 * union, for columns or numbers."""
    return (100 + PERCENT) * shared >= PERCENT * (a + b)


class SignatureTree:
    """Levels of nodes over sorted sets: OR of bitmaps, size range, largest surplus of members over bits, component or -1."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        slack = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, slack, comps)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, slack, comps = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            first = np.minimum.reduceat(comps, at)
            self.levels.append((
                np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at),
                np.where(first == np.maximum.reduceat(comps, at), first, np.iinfo(np.int64).min),
            ))


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray) -> np.ndarray:
    """Whether pairs of nodes (i of x, j of y) can hold a link between two components."""
    mixed = np.iinfo(np.int64).min
    ok = (x[4][i] != y[4][j]) | (x[4][i] == mixed)
    ok &= (100 * y[2][j] >= PERCENT * x[1][i]) & (100 * x[2][i] >= PERCENT * y[1][j])
    i, j = i[ok], j[ok]
    most = np.bitwise_count(x[0][i] & y[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(x[3][i], y[3][j])
    most = np.minimum(most, np.minimum(x[2][i], y[2][j]))
    ok[ok] = overlap_enough(most, x[1][i], y[1][j])
    return ok


def dual_traversal(x: SignatureTree, y: SignatureTree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that the bounds don't exclude; same: both trees are one, each pair is met once."""
    i = j = np.zeros(1, dtype=np.int64)
    a, b = len(x.levels) - 1, len(y.levels) - 1
    keep = possible(x.levels[a], i, y.levels[b], j)
    i, j = i[keep], j[keep]
    while a or b:
        down_a, down_b = a >= b and a > 0, b >= a and b > 0
        found_i, found_j = [], []
        for start in range(0, len(i), 4096):  # a bounded number of node pairs at once
            ci, cj = i[start : start + 4096], j[start : start + 4096]
            if down_a:
                ci = np.repeat(ci, FANOUT) * FANOUT + np.tile(np.arange(FANOUT), len(ci))
                cj = np.repeat(cj, FANOUT)
                ok = ci < len(x.levels[a - 1][1])
                ci, cj = ci[ok], cj[ok]
            if down_b:
                cj = np.repeat(cj, FANOUT) * FANOUT + np.tile(np.arange(FANOUT), len(cj))
                ci = np.repeat(ci, FANOUT)
                ok = cj < len(y.levels[b - 1][1])
                ci, cj = ci[ok], cj[ok]
            if same:
                ok = ci <= cj
                ci, cj = ci[ok], cj[ok]
            keep = possible(x.levels[a - down_a], ci, y.levels[b - down_b], cj)
            found_i.append(ci[keep])
            found_j.append(cj[keep])
        a, b = a - down_a, b - down_b
        i = np.concatenate(found_i) if found_i else i[:0]
        j = np.concatenate(found_j) if found_j else j[:0]
    return (i[i != j], j[i != j]) if same else (i, j)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The stretches of rows that agree in some columns, of rows sorted by these."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        own = batch[keys].to_numpy()
        cuts = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(batch)]
        if held and (held[-1][keys].iloc[-1].to_numpy() != own[0]).any():
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        for low, high in zip(bounds, bounds[1:], strict=False):
            held.append(batch.iloc[low:high])
            if high < len(batch):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def tree_of(cls: np.ndarray, n: np.ndarray, comp: np.ndarray, bitmap: list[bytes]) -> tuple[SignatureTree, np.ndarray]:
    """The tree over some classes, put in order of component and size, and the classes in that order."""
    order = np.lexsort((cls, n, comp))
    bits = np.frombuffer(b"".join(bitmap), dtype=np.uint64).reshape(len(cls), -1)
    return SignatureTree(bits[order], n[order].astype(np.int64), comp[order].astype(np.int64)), cls[order]


def columns_of(rows: pd.DataFrame, *names: str) -> list:
    return [rows[c].to_numpy() for c in names] + [rows["bitmap"].to_list()]


def first_groups(rows: pd.DataFrame) -> dict[int, np.ndarray]:
    return dict(zip(rows["cls"], rows["firsts"], strict=True))


def met_before(gid: int, a: np.ndarray, b: np.ndarray, firsts: dict[int, np.ndarray]) -> np.ndarray:
    """Whether the classes of each pair share one of their first groups that comes before this one, whose trees give the pair then: what the bounds say of two leaves is the same in every group."""
    table = np.full((len(firsts), FIRST_GROUPS), gid, dtype=np.int64)
    row = {}
    for k, (cls, own) in enumerate(firsts.items()):
        table[k, : len(own)] = own
        row[cls] = k
    x, y = (np.array([row[c] for c in side.tolist()], dtype=np.int64) for side in (a, b))
    out = np.zeros(len(a), dtype=bool)
    for start in range(0, len(a), 4096):  # a bounded number of pairs at once
        p, q = table[x[start : start + 4096]], table[y[start : start + 4096]]
        out[start : start + 4096] = ((p[:, :, None] == q[:, None, :]) & (p[:, :, None] < gid)).any(axis=(1, 2))
    return out


def pairs_frame(found: list[tuple[np.ndarray, np.ndarray, int]]) -> pd.DataFrame:
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return pd.DataFrame({"a": a, "b": b, "weight": np.repeat([f[2] for f in found], [len(f[0]) for f in found])})


def search_by_leader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group and block: (leader, class, weight) where the leader's way down the tree ends at the class."""
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    for group in runs(batches, ["gid", "block"]):
        cls, lead = group["cls"].to_numpy(), int(group["lead"].iloc[0])
        at = int(np.flatnonzero(cls == lead)[0])
        group = group.iloc[np.flatnonzero((cls != lead) | (np.arange(len(cls)) == at))]
        cls, n, bitmap = columns_of(group, "cls", "n")
        tree, own = tree_of(cls, n, cls, bitmap)
        k = np.flatnonzero(own == lead)
        bits, sizes = tree.levels[0][0][k], tree.levels[0][1][k]
        _, j = dual_traversal(SignatureTree(bits, sizes, own[k]), tree, False)
        if len(j):
            found.append((np.full(len(j), lead), own[j], int(group["weight"].iloc[0])))
        if len(found) >= 1000:
            yield pairs_frame(found)
            found = []
    if found:
        yield pairs_frame(found)


def roots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group and block: the root of each block's tree."""
    for batch in batches_of(
        ((int(g["gid"].iloc[0]), int(g["block"].iloc[0]), *(x[0] for x in tree_of(*columns_of(g, "cls", "n", "comp"))[0].levels[-1])) for g in runs(batches, ["gid", "block"])), 1000
    ):
        out = pd.DataFrame(batch, columns=["gid", "block", "bitmap", "low", "high", "slack", "comp"])
        out["bitmap"] = [b.tobytes() for b in out["bitmap"]]
        yield out


def batches_of(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def root_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of blocks of which the roots don't say that no link is in them."""
    for batch in batches:
        x, y = ((np.frombuffer(b"".join(batch[f"{s}_bitmap"]), dtype=np.uint64).reshape(len(batch), -1), *(batch[f"{s}_{c}"].to_numpy(dtype=np.int64) for c in ("low", "high", "slack", "comp"))) for s in "xy")
        at = np.arange(len(batch))
        keep = possible(x, at, y, at)
        yield batch.loc[keep, ["gid", "i", "j"]]


def search_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group and pair of blocks: the candidate pairs of each pair of trees, but for those that an earlier group gives."""
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    for group in runs(batches, ["gid", "i", "j"]):
        i, j, block = int(group["i"].iloc[0]), int(group["j"].iloc[0]), group["block"].to_numpy()
        x, own_x = tree_of(*columns_of(group[block == i], "cls", "n", "comp"))
        y, own_y = (x, own_x) if i == j else tree_of(*columns_of(group[block == j], "cls", "n", "comp"))
        p, q = dual_traversal(x, y, i == j)
        a, b = own_x[p], own_y[q]
        if len(a):
            fresh = ~met_before(int(group["gid"].iloc[0]), a, b, first_groups(group))
            a, b = a[fresh], b[fresh]
        if len(a):
            found.append((np.minimum(a, b), np.maximum(a, b), 1))
        if len(found) >= 1000:
            yield pairs_frame(found)
            found = []
    if found:
        yield pairs_frame(found)


def may_link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that share enough leading members. Of two sets, the one whose leading members end first in the order shares with the other only leading members up to there, and what it has beyond."""
    for batch in batches:
        keep = np.zeros(len(batch), dtype=bool)
        for k, (na, nb, x, weights, y) in enumerate(zip(batch["na"], batch["nb"], batch["a_groups"], batch["a_weights"], batch["b_groups"], strict=True)):
            shared = int(weights[np.isin(x, y)].sum())
            keep[k] = overlap_enough(shared + max(na - leading(na), nb - leading(nb)), na, nb)
        yield batch.loc[keep, ["a", "b"]]


def check_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts that have the wanted class, since rows may share an id."""
    seen: set[int] = set()
    for batch in batches:
        rows = []
        for text, cls in zip(batch["packed"], batch["wanted"], strict=True):
            if cls not in seen and class_of(shingle_set(unpack_text(text))) == cls:
                seen.add(cls)  # else a repeated row
                rows.append((cls, text))
        yield pd.DataFrame(rows, columns=["cls", "packed"])


def check_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = np.zeros(len(batch), dtype=bool)
        for k, (left, right) in enumerate(zip(batch["__a"], batch["__b"], strict=True)):
            x, y = shingle_set(unpack_text(left)), shingle_set(unpack_text(right))
            keep[k] = overlap_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
        yield batch.loc[keep, ["a", "b"]]


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links, on their whole texts; those travel packed, which is smaller than their sets."""
    needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = classes.join(needed, "cls", "left_semi").select("doc_id", F.col("cls").alias("wanted"))
    texts = packed(docs, ["doc_id"])
    rows = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"])).select("packed", "wanted")
    facts = written(mapped(rows, check_class, "cls long, packed binary"), "jaccard-facts")
    left = facts.select(F.col("cls").alias("a"), F.col("packed").alias("__a"))
    right = facts.select(F.col("cls").alias("b"), F.col("packed").alias("__b"))
    out = written(mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "__a", "__b"), check_pairs, "a long, b long"), "jaccard-links")
    discard(facts)
    return out


def leading_members(docs: DataFrame, common: pd.DataFrame) -> DataFrame:
    """(token, salt, cls): the leading members of every class, common ones with a salt, which keeps rows of the next step small."""
    shared = docs.sparkSession.sparkContext.broadcast((common["cls"].to_numpy(dtype=np.int64).astype(np.uint64), common["times"].to_numpy(dtype=np.int64)))  # at most COMMON_KEPT

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.argsort(shared.value[0])
        known, times = shared.value[0][order], shared.value[1][order]
        seen: set[int] = set()
        for batch in batches:
            token, salt, cls = [], [], []
            for text in batch["text"]:
                own = shingle_set(as_bytes(text))
                c = class_of(own)
                if not len(own) or c in seen:
                    continue
                seen.add(c)
                often = np.zeros(len(own), dtype=bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    often = known[at] == own
                p = leading(len(own))
                rare = own[~often][:p]
                rest = own[often][: p - len(rare)]
                token += [rare, rest]
                salt += [np.zeros(len(rare), dtype=np.int64), 1 + c % (1 + times[at[often][: len(rest)]] // GROUP_ROWS) if len(rest) else np.zeros(0, dtype=np.int64)]
                cls.append(np.full(p, c, dtype=np.int64))
            if cls:
                yield pd.DataFrame({"token": np.concatenate(token).astype(np.int64), "salt": np.concatenate(salt), "cls": np.concatenate(cls)})

    return mapped(docs.select("text"), tokens, "token long, salt long, cls long")


def leaves_of(docs: DataFrame, classes: DataFrame, common: pd.DataFrame) -> DataFrame:
    """(gid, weight, cls, n, bitmap, score): the leaves of all trees. A group stands for `weight` leading members with the same classes."""
    groups = leading_members(docs, common).groupBy("token", "salt").agg(F.array_sort(F.collect_set("cls")).alias("own")).filter("size(own) > 1 OR salt > 0")
    alone = F.when(F.col("salt") > 0, F.col("token"))  # parts of a common member's group come together again by its name
    groups = groups.groupBy(alone.alias("alone"), F.xxhash64("own").alias("h1"), F.xxhash64("own", F.lit(1)).alias("h2")).agg(F.min("token").alias("gid"), F.count("*").alias("weight"), F.first("own").alias("own"))
    edges = written(groups.select("gid", "weight", F.explode("own").alias("cls")), "jaccard-edges")
    lead = F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100") + 1 + F.expr(f"n div {DEPTH}")
    degree = edges.groupBy("cls").agg(F.sum("weight").alias("met")).join(classes.select("cls", "n", "bitmap"), "cls").filter(f"met >= 1 + {PERCENT} * n div {100 * DEPTH}")  # of a partner with 0.8 n at least
    out = written(edges.join(degree.select("cls", "n", "bitmap", (F.col("met") * 1000 / lead).cast("int").alias("score")), "cls").select("gid", "weight", "cls", "n", "bitmap", "score"), "jaccard-leaves")
    discard(edges)
    return out


def leader_pairs(leaves: DataFrame) -> DataFrame:
    """(a, b): for each class b the leader a that it meets most often by way of the trees."""
    groups = leaves.groupBy("gid").agg(F.count("*").alias("rows"), F.max(F.struct("score", "cls"))["cls"].alias("lead")).filter("rows > 1")
    slices = F.floor(F.col("rows") / BLOCK_ROWS).cast("int") + 1
    own = F.when(F.col("cls") == F.col("lead"), F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls"), slices).cast("int")))  # the leader meets each tree of its group
    dealt = leaves.join(groups, "gid").select("gid", F.explode(own).alias("block"), "weight", "cls", "n", "bitmap", "lead")
    dealt = dealt.repartition("gid", "block").sortWithinPartitions("gid", "block")
    votes = mapped(dealt, search_by_leader, "a long, b long, weight long").groupBy("b", "a").agg(F.sum("weight").alias("votes"))
    return written(votes.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b"), "jaccard-stars")


def open_pairs(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): candidates between the components that still meet in a group."""
    placed = leaves.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("gid", "weight", "cls", "n", "bitmap", F.coalesce("label", "cls").alias("comp"))
    mixed = placed.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("gid")
    left = written(placed.join(mixed, "gid").withColumn("range", F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("long")), "jaccard-open")  # a link reaches the next range at most
    seats = left.groupBy("cls").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("gid", "weight"))).alias("met"))
    seats = written(seats.select("cls", "n", F.slice("met.gid", 1, FIRST_GROUPS).alias("firsts"), F.transform("met", lambda m: F.hash(m["gid"])).alias("groups"), F.transform("met", lambda m: m["weight"].cast("int")).alias("weights")), "jaccard-seats")  # groups: short names, a clash only counts a member too many
    of_range = left.groupBy("gid", "range").agg(F.count("*").alias("of_range"))
    of_comp = left.groupBy("gid", "range", "comp").agg(F.count("*").alias("of_comp"))
    slice_ = F.when(F.col("of_comp") >= BLOCK_ROWS, F.xxhash64("comp", F.pmod("cls", F.floor(F.col("of_comp") / BLOCK_ROWS) + 1))).otherwise(F.pmod(F.xxhash64("comp"), F.floor(F.col("of_range") / BLOCK_ROWS) + 1))
    blocks = left.join(of_range, ["gid", "range"]).join(of_comp, ["gid", "range", "comp"]).join(seats.select("cls", "firsts"), "cls")
    blocks = blocks.select("gid", F.xxhash64("range", slice_).alias("block"), "range", "cls", "n", "bitmap", "comp", "firsts")
    blocks = written(blocks, "jaccard-blocks")
    roots = written(mapped(blocks.drop("range", "firsts").repartition("gid", "block").sortWithinPartitions("gid", "block"), roots_of, "gid long, block long, bitmap binary, low long, high long, slack long, comp long"), "jaccard-roots")
    ranges = blocks.select("gid", "block", "range").distinct()
    placed_roots = roots.join(ranges, ["gid", "block"])
    side = lambda s, b: placed_roots.select("gid", F.col("range").alias(f"{s}_range"), F.col("block").alias(b), *[F.col(c).alias(f"{s}_{c}") for c in ("bitmap", "low", "high", "slack", "comp")])
    near = side("x", "i").withColumn("y_range", F.explode(F.array("x_range", F.col("x_range") + 1))).join(side("y", "j"), ["gid", "y_range"]).filter("x_range < y_range OR i <= j")
    tasks = mapped(near.select("gid", "i", "j", *[f"{s}_{c}" for s in "xy" for c in ("bitmap", "low", "high", "slack", "comp")]), root_pairs, "gid long, i long, j long")
    tasks = written(tasks, "jaccard-tasks")
    dealt = tasks.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    rows = blocks.drop("range").join(dealt, ["gid", "block"]).repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j")
    found = written(mapped(rows, search_blocks, "a long, b long, weight long").select("a", "b").distinct(), "jaccard-found")
    met = lambda s: seats.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("groups").alias(f"{s}_groups"), F.col("weights").alias(f"{s}_weights"))
    sides = found.join(met("a"), "a").join(met("b").drop("b_weights"), "b")
    out = written(mapped(sides, may_link, "a long, b long"), "jaccard-pairs")
    discard(left, seats, blocks, roots, tasks, found)
    return out


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    component_id is the smallest id that links reach. A text without words (null, empty, blank) has
    an empty set, no links, and its own id. Rows that repeat an id are documents of their own with
    the same id; a null id counts as the largest; ids may be texts. An empty table gives an empty result; other columns are not read.
    """
    kind = dict(df.dtypes)[id_col]
    numbers = kind in ("tinyint", "smallint", "int", "bigint")
    docs = df.select(F.col(id_col).cast("long" if numbers else kind).alias("doc_id"), F.col(text_col).alias("text"))
    first = written(mapped(docs, lambda batches: first_pass(batches, numbers), f"doc_id {'long' if numbers else kind}, {FIRST}"), "jaccard-first")
    members = first.filter("n IS NOT NULL").select("doc_id", "cls", "n", "bitmap")
    common = first.filter("times IS NOT NULL").groupBy("cls").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "cls").limit(COMMON_KEPT).toPandas()  # at most COMMON_KEPT
    classes = written(members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bitmap").alias("bitmap")), "jaccard-classes")
    leaves = leaves_of(docs, classes, common)
    stars = leader_pairs(leaves)
    links = verified(stars, docs, classes)
    labels = components(links)
    pairs = open_pairs(leaves, labels)
    discard(leaves)
    more = verified(pairs, docs, classes)
    final = labels if more.isEmpty() else components(links.unionByName(more))

    grouped = written(classes.join(final.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label")), "jaccard-grouped")
    discard(classes, stars, links, pairs, more)
    heads = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    heads = grouped.join(heads, "label").select("cls", "component_id")
    out = members.select("doc_id", "cls", "n").join(heads, "cls", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that are the first of their component; texts without words stay, and of rows with one id and text all stay or go."""
    found = jaccard_components(df, id_col, text_col)
    kept = found.filter(F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("__kept")).distinct()
    return df.join(kept, df[id_col].eqNullSafe(kept["__kept"]), "left_semi")
