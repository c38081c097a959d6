"""Weighted acyclic automata over 64-bit labels, as flat arrays.

A path from the start state (0) spells a phrase of labels; the weight of its last arc is the phrase's count (0: the phrase is only a
prefix). Arcs leave a state in label order. Equal states are one: the automaton is minimised from its last level up, as the sorted
phrases are taken level by level. All work on a level is one array operation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NONE = np.int32(-1)


@dataclass
class Automaton:
    first: np.ndarray  # state -> its first arc; one more entry than states
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray  # -1: no arcs follow

    def to_bytes(self) -> bytes:
        """Header of the two sizes, then the arrays; weights in the fewest bytes that hold them."""
        top = int(self.weight.max()) if len(self.weight) else 0
        width = 1 if top < 1 << 8 else 4 if top < 1 << 32 else 8
        head = np.array([len(self.first), len(self.label), width], "<i8")
        parts = (head, self.first.astype("<i4"), self.label.astype("<u8"), self.weight.astype(f"<u{width}"), self.target.astype("<i4"))
        return b"".join(p.tobytes() for p in parts)


def from_bytes(raw: bytes) -> Automaton:
    states, arcs, width = np.frombuffer(raw, "<i8", 3).tolist()
    at, out = 24, []
    for kind, n in (("<i4", states), ("<u8", arcs), (f"<u{width}", arcs), ("<i4", arcs)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return Automaton(out[0], out[1], out[2].astype(np.int64), out[3])


def in_order(paths: np.ndarray) -> np.ndarray:
    """Order of phrases (rows; 0 fills the end of short ones) by their labels."""
    return np.lexsort([paths[:, d] for d in range(paths.shape[1] - 1, -1, -1)])


def summed(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases in order with the sums of their weights."""
    if not len(paths):
        return paths, weights
    order = in_order(paths)
    paths, weights = paths[order], weights[order]
    new = np.ones(len(paths), bool)
    new[1:] = (paths[1:] != paths[:-1]).any(1)
    return paths[new], np.add.reduceat(weights, np.flatnonzero(new))


def build(paths: np.ndarray, weights: np.ndarray) -> Automaton:
    """The automaton of distinct phrases in order; labels are not 0."""
    depth = paths.shape[1]
    levels, node = [], np.zeros(len(paths), np.int64)
    for d in range(depth):
        rows = np.flatnonzero(paths[:, d] != 0)
        if not len(rows):
            break
        state, label = node[rows], paths[rows, d]
        new = np.ones(len(rows), bool)
        new[1:] = (state[1:] != state[:-1]) | (label[1:] != label[:-1])
        arc = np.cumsum(new) - 1
        ends = np.ones(len(rows), bool) if d + 1 == depth else paths[rows, d + 1] == 0
        weight = np.zeros(arc[-1] + 1, np.int64)
        weight[arc[ends]] = weights[rows[ends]]
        goes = np.zeros(arc[-1] + 1, bool)
        goes[arc[~ends]] = True
        # the arcs that go on lead to the next level's states, numbered in order
        target = np.where(goes, np.cumsum(goes) - 1, -1)
        levels.append((state[new], label[new], weight, target))
        node = np.full(len(paths), -1, np.int64)
        node[rows] = target[arc]
    return _minimised(levels)


def _mixed(*columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _minimised(levels: list) -> Automaton:
    """Merge equal states of a level, the last level first, and number the states from the start."""
    kept = []
    for state, label, weight, target in reversed(levels):
        if kept:  # targets by the merged numbers of the level below
            target = np.where(target >= 0, kept[-1][0][target], -1)
        starts = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
        size = np.diff(np.r_[starts, len(state)])
        sign = np.add.reduceat(_mixed(label, weight, target.astype(np.int64) + 1), starts)
        lead, number = _grouped(sign, size)
        # equal sums of equal sizes are equal arcs unless hashes collide: such states stay apart
        arcs = np.repeat(starts[lead[number]], size) + (np.arange(len(state)) - np.repeat(starts, size))
        same = (label == label[arcs]) & (weight == weight[arcs]) & (target == target[arcs])
        apart = ~np.logical_and.reduceat(same, starts)
        if apart.any():
            lead = np.r_[lead, np.flatnonzero(apart)]
            number[apart] = np.arange(len(lead) - apart.sum(), len(lead))
        pick = np.concatenate([[0], np.cumsum(size[lead])])
        of = np.repeat(starts[lead] - pick[:-1], size[lead]) + np.arange(pick[-1])
        kept.append((number, pick, label[of], weight[of], target[of]))
    first, label, weight, target, base = [np.zeros(1, np.int64)], [], [], [], 0
    if not kept:
        return Automaton(np.zeros(2, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    arcs = 0
    for _, pick, lab, wei, tar in reversed(kept):
        base += len(pick) - 1
        first.append(pick[1:] + arcs)
        arcs += len(lab)
        label.append(lab)
        weight.append(wei)
        target.append(np.where(tar >= 0, tar + base, -1))
    return Automaton(np.concatenate(first), np.concatenate(label), np.concatenate(weight), np.concatenate(target).astype(np.int32))


def _grouped(sign: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First member and group number of equal (sign, size)."""
    order = np.lexsort([size, sign])
    new = np.ones(len(order), bool)
    new[1:] = (sign[order[1:]] != sign[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def paths_of(aut: Automaton, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All phrases in order of length and labels, and their weights."""
    out, weights = [], []
    state, prefix = np.zeros(1, np.int64), np.zeros((1, depth), np.uint64)
    for d in range(depth):
        size = (aut.first[state + 1] - aut.first[state]).astype(np.int64)
        total = int(size.sum())
        if not total:
            break
        arc = np.repeat(aut.first[state] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total)
        prefix = np.repeat(prefix, size, axis=0)
        prefix[:, d] = aut.label[arc]
        some = aut.weight[arc] > 0
        out.append(prefix[some])
        weights.append(aut.weight[arc][some])
        goes = aut.target[arc] >= 0
        state, prefix = aut.target[arc][goes].astype(np.int64), prefix[goes]
    if not out:
        return np.zeros((0, depth), np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(weights)


def union(automata: list[Automaton], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of all automata in order, with the sums of their weights."""
    parts = [paths_of(a, depth) for a in automata]
    return summed(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]))


def lookup(aut: Automaton, queries: np.ndarray) -> np.ndarray:
    """Composition with the phrases (rows; 0 fills the end): the weight each one's path ends with, 0 for none."""
    out, state = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    if not len(aut.label):
        return out
    top = len(aut.label) - 1
    for d in range(queries.shape[1]):
        rows = np.flatnonzero(queries[:, d] != 0)
        out[rows] = 0
        rows = rows[state[rows] >= 0]
        if not len(rows):
            break
        want = queries[rows, d]
        low, high = aut.first[state[rows]].astype(np.int64), aut.first[state[rows] + 1].astype(np.int64)
        end = high.copy()
        while (low < high).any():
            mid = (low + high) // 2
            less = (low < high) & (aut.label[np.minimum(mid, top)] < want)
            high = np.where((low < high) & ~less, mid, high)
            low = np.where(less, mid + 1, low)
        at = np.minimum(low, top)
        hit = (low < end) & (aut.label[at] == want)
        out[rows[hit]] = aut.weight[at[hit]]
        state[rows] = np.where(hit, aut.target[at], -1)
    return out
