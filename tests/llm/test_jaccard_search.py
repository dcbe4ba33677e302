"""The search of op5's open groups: rows that it gives, and bounds on its pairs."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd

from cuelake.llm import jaccard


def leaves(gid: int, sets: dict[int, np.ndarray], groups: list[int]) -> pd.DataFrame:
    """A group's only block, of classes that are components of their own and meet in some groups."""
    return pd.DataFrame([(gid, 7, 7, 7, c, len(m), jaccard.bitmap_of(m), c, np.array(groups[: jaccard.FIRST_GROUPS], dtype=np.int64)) for c, m in sets.items()], columns=["gid", "i", "j", "block", "cls", "n", "bitmap", "comp", "firsts"])


def test_pair_of_many_groups_is_given_once():
    """Classes that meet in fifty groups are candidates of the first of these; those that share none of their first groups are candidates wherever they meet."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sets = {c: np.unique(np.concatenate([base[:860], rng.integers(0, 1 << 63, 40, dtype=np.uint64)])) for c in range(6)}
    groups = list(range(-25, 25))
    found = pd.concat(jaccard.search_blocks(iter([leaves(g, sets, groups) for g in groups])))
    assert sorted(zip(found["a"], found["b"], strict=True)) == list(itertools.combinations(range(6), 2))
    apart = pd.concat([leaves(40, {0: sets[0]}, list(range(20))), leaves(40, {1: sets[1]}, list(range(20, 60)))])
    assert len(pd.concat(jaccard.search_blocks(iter([apart])))) == 1


def test_leading_members_rule_out_no_link():
    """Random pairs around the limit, of many sizes: a pair that links shares enough leading members, and most of those far from it don't."""
    rng = np.random.default_rng(6)
    rows, links = [], []
    for k in range(2000):
        n = int(rng.integers(1, 400))
        x = rng.choice(1 << 40, n, replace=False)
        y = np.unique(np.concatenate([rng.choice(x, max(1, int(n * rng.uniform(0.5, 1))), replace=False), rng.choice(1 << 40, int(rng.integers(0, 1 + n // 4)), replace=False)]))
        x = np.sort(x)
        links.append(bool(jaccard.overlap_enough(len(np.intersect1d(x, y)), len(x), len(y))))
        a, b = (v[: jaccard.leading(len(v))] for v in (x, y))
        rows.append((k, k, len(x), len(y), a, np.ones(len(a), dtype=np.int32), b))
    out = pd.concat(jaccard.may_link(iter([pd.DataFrame(rows, columns=["a", "b", "na", "nb", "a_groups", "a_weights", "b_groups"])])))
    kept = set(out["a"])
    assert 100 < sum(links) < 1900
    assert all(k in kept for k in range(2000) if links[k])
    far = pd.DataFrame([(0, 1, 400, 400, np.arange(101), np.ones(101, dtype=np.int32), np.arange(60, 161))], columns=["a", "b", "na", "nb", "a_groups", "a_weights", "b_groups"])
    assert not len(pd.concat(jaccard.may_link(iter([far]))))
