"""Vantage-point partition of 64-bit fingerprints under the Hamming distance.

A level of the tree measures the distance to the vantage point on four bits of its
own, so the children of a node are the shells 0 to 4. Distances on separate bits add
up, and so do the triangle bounds: two fingerprints differ by at least the sum, over
the levels, of the difference of their shells. A branch is cut as soon as that sum
passes the radius.

Two fingerprints within 4 bits differ by at most 2 bits on one of the two halves. One
tree on each half, searched with radius 2, therefore finds every pair, and cuts far
more than one tree searched with radius 4.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np

from roomtable.llm.shared import pair_ranges

RADIUS = 4
HALVES = 2
HALF_RADIUS = RADIUS // HALVES
LEVELS = 8
SHELLS = 5
VANTAGE = np.uint64(0x9E3779B97F4A7C15)
_POPCOUNT = np.array([bin(i).count("1") for i in range(16)], np.uint8)
_PAIRS_AT_ONCE = 1 << 21


def shells(fingerprints: np.ndarray, half: int, levels: int = LEVELS) -> np.ndarray:
    """Distance to the vantage point at each level: an array of (fingerprint, level)."""
    apart = (fingerprints ^ VANTAGE) >> np.uint64(32 * half)
    return np.stack([_POPCOUNT[((apart >> np.uint64(4 * i)) & np.uint64(15)).astype(np.intp)] for i in range(levels)], 1)


def path_code(steps: np.ndarray) -> np.ndarray:
    code = np.zeros(len(steps), np.int64)
    for i in range(steps.shape[1]):
        code = code * SHELLS + steps[:, i]
    return code


def boundary_steps(levels: int) -> np.ndarray:
    """Shell differences whose sum stays within the radius of a half."""
    reach = range(-HALF_RADIUS, HALF_RADIUS + 1)
    found = [()]
    for _ in range(levels):
        found = [(*x, d) for x, d in itertools.product(found, reach) if sum(map(abs, x)) + abs(d) <= HALF_RADIUS]
    return np.array(found, np.int64).reshape(len(found), levels)


def shard_visits(fingerprints: np.ndarray, half: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, home shard, visited shard): the home and all shards the search ball overlaps."""
    steps = shells(fingerprints, half, levels).astype(np.int64)
    home, rows, visited = path_code(steps), [], []
    for move in boundary_steps(levels):
        there = steps + move
        inside = np.flatnonzero(((there >= 0) & (there < SHELLS)).all(1))
        rows.append(inside)
        visited.append(path_code(there[inside]))
    row = np.concatenate(rows)
    return row, home[row], np.concatenate(visited)


class _Tree:
    """Fingerprints in path order; a node of a level is a range of them."""

    def __init__(self, fingerprints: np.ndarray, half: int):
        steps = shells(fingerprints, half)
        self.order = np.argsort(path_code(steps), kind="stable")
        self.values = fingerprints[self.order]
        steps = steps[self.order]
        self.levels = []
        fresh = np.zeros(len(steps), bool)
        fresh[:1] = True
        start = np.flatnonzero(fresh)
        for i in range(LEVELS):
            fresh[1:] |= steps[1:, i] != steps[:-1, i]
            below = np.flatnonzero(fresh)
            first = np.searchsorted(below, start)
            self.levels.append((first, np.diff(np.append(first, len(below))), steps[below, i].astype(np.int64)))
            start = below
        self.start, self.size = start, np.diff(np.append(start, len(steps)))


def near_pairs(left: np.ndarray, right: np.ndarray | None, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within RADIUS that the tree of this half can reach, in blocks.

    With `right` None the pairs are those inside `left`, each once. Both trees are
    walked together, level by level; memory stays bounded because a large frontier is
    split and its parts are finished one after the other.
    """
    a = _Tree(left, half)
    b = a if right is None else _Tree(right, half)
    if not len(left) or not len(b.values):
        return
    zero = np.zeros(1, np.int64)
    work = [(0, zero, zero, zero)]
    while work:
        level, at, to, used = work.pop()
        if level < LEVELS:
            (first_a, count_a, step_a), (first_b, count_b, step_b) = a.levels[level], b.levels[level]
            i, j = pair_ranges(first_a[at], count_a[at], first_b[to], count_b[to])
            spent = np.repeat(used, count_a[at] * count_b[to]) + np.abs(step_a[i] - step_b[j])
            keep = spent <= HALF_RADIUS
            if right is None:
                keep &= i <= j
            i, j, spent = i[keep], j[keep], spent[keep]
            for k in range(0, len(i), _PAIRS_AT_ONCE // 25):
                part = slice(k, k + _PAIRS_AT_ONCE // 25)
                work.append((level + 1, i[part], j[part], spent[part]))
            continue
        sizes = a.size[at] * b.size[to]
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(ends, np.arange(_PAIRS_AT_ONCE, int(ends[-1]) + _PAIRS_AT_ONCE, _PAIRS_AT_ONCE), "left") + 1
        for k, end in itertools.pairwise([0, *dict.fromkeys(np.minimum(cuts, len(at)).tolist())]):
            i, j = pair_ranges(a.start[at[k:end]], a.size[at[k:end]], b.start[to[k:end]], b.size[to[k:end]])
            near = np.bitwise_count(a.values[i] ^ b.values[j]) <= RADIUS
            if right is None:
                near &= i < j
            if near.any():
                yield a.order[i[near]], b.order[j[near]]


def spanning_links(left: np.ndarray, right: np.ndarray | None, half: int) -> np.ndarray:
    """Links (fingerprint, representative) that join what near_pairs would join.

    At most one link for each fingerprint, however many of them are near each other.
    """
    values = left if right is None else np.concatenate([left, right])
    root = np.arange(len(values))
    for i, j in near_pairs(left, right, half):
        j = j if right is None else j + len(left)
        while True:
            low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            open_ = low < high
            if not open_.any():
                break
            i, j = i[open_], j[open_]
            np.minimum.at(root, high[open_], low[open_])
            while not np.array_equal(root, up := root[root]):
                root = up
    moved = np.flatnonzero(root != np.arange(len(values)))
    return np.stack([values[moved], values[root[moved]]], 1)
