"""Weighted acyclic automata over words: count transducers for word n-grams of one to three words.

An automaton reads an n-gram word by word; every arc has a label (a word), a weight (the count of the n-gram that ends with it) and a
target. It is built from n-grams in sorted order, in one sweep: a row opens states only beyond the prefix that it shares with the row
before. States two words deep with the same arcs and weights are stored once, and all n-grams of full length end in one final state.
"""

from __future__ import annotations

import struct

import numpy as np

DEPTH = 3


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices ``start[i] .. start[i] + count[i] - 1`` of all i, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


def _share(n: int, parent: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Give the ``n`` states with these arcs numbers so that equal ones share a number: state of each, first and number of arcs of each number."""
    degree = np.bincount(parent, minlength=n)
    begin = np.cumsum(degree) - degree
    state, first, count = np.zeros(n, np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    single = np.flatnonzero(degree == 1)
    if len(single):
        at = begin[single]
        order = np.lexsort((weight[at], label[at]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(label[at][order]) != 0) | (np.diff(weight[at][order]) != 0)
        state[single[order]] = np.cumsum(new)
        first.append(at[order][new])
        count.append(np.ones(int(new.sum()), np.int64))
    many, seen, base = np.flatnonzero(degree > 1), {}, sum(map(len, first))
    if len(many):
        arcs = np.stack((label, weight), axis=1)
        numbers, firsts = [], []
        for a, d in zip(begin[many].tolist(), degree[many].tolist(), strict=True):
            number = seen.setdefault(arcs[a : a + d].tobytes(), len(seen))
            if number == len(firsts):
                firsts.append((a, d))
            numbers.append(number)
        state[many] = np.array(numbers) + base
        first.append(np.array([a for a, _ in firsts], np.int64))
        count.append(np.array([d for _, d in firsts], np.int64))
    return state, np.concatenate(first), np.concatenate(count)


class CountAutomaton:
    """``words`` is sorted; labels are indices into it. ``arcs[d]`` has label, weight and target of the arcs of depth d; ``begin[d]`` and ``size[d]`` have those of a state."""

    def __init__(self, words: list[bytes], arcs: list[tuple], begin: list, size: list):
        self.words, self.arcs, self.begin, self.size = words, arcs, begin, size

    @classmethod
    def from_sorted(cls, words: list[bytes], grams: np.ndarray, weights: np.ndarray) -> CountAutomaton:
        """``grams`` has a row per n-gram, in order: indices into ``words``, -1 after its end."""
        rows = len(grams)
        new = np.zeros((rows, DEPTH), bool)
        # the first column that differs from the row before opens this state and all behind it
        differs = np.ones((rows, DEPTH), bool)
        differs[1:] = grams[1:] != grams[:-1]
        new = np.maximum.accumulate(differs, axis=1) & (grams >= 0)
        length = (grams >= 0).sum(axis=1)
        node = np.cumsum(new, axis=0) - 1
        label, weight, parent = [], [], []
        for d in range(DEPTH):
            opens = np.flatnonzero(new[:, d])
            label.append(grams[opens, d])
            w = np.zeros(len(opens), np.int64)
            ends = np.flatnonzero(length == d + 1)
            w[node[ends, d]] = weights[ends]
            weight.append(w)
            parent.append(node[opens, d - 1] if d else np.zeros(len(opens), np.int64))
        degree = [np.bincount(parent[d], minlength=len(label[d - 1]) if d else 1) for d in range(DEPTH)]
        begin = [np.cumsum(g) - g for g in degree]
        state, first, count = _share(len(label[1]), parent[2], label[2], weight[2])
        kept = _spans(first, count)
        none = np.zeros(len(kept), np.int64)
        arcs = [(label[0], weight[0], np.arange(len(label[0]))), (label[1], weight[1], state), (label[2][kept], weight[2][kept], none)]
        return cls(words, arcs, [begin[0], begin[1], np.cumsum(count) - count], [degree[0], degree[1], count])

    def expand(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams that have a weight, in order, and the weights."""
        prefix = np.zeros((1, 0), np.int64)
        states = np.zeros(1, np.int64)
        grams, weights = [], []
        for d in range(DEPTH):
            label, weight, target = self.arcs[d]
            count = self.size[d][states]
            at = _spans(self.begin[d][states], count)
            prefix = np.concatenate((np.repeat(prefix, count, axis=0), label[at][:, None]), axis=1)
            states = target[at]
            has = weight[at] > 0
            grams.append(np.pad(prefix[has], ((0, 0), (0, DEPTH - d - 1)), constant_values=-1))
            weights.append(weight[at][has])
        grams, weights = np.concatenate(grams), np.concatenate(weights)
        order = np.lexsort(grams.T[::-1])
        return grams[order], weights[order]

    def compose(self, asked: CountAutomaton) -> np.ndarray:
        """The weights that the n-grams of ``asked`` (as ``asked.expand`` lists them) have here, 0 for none: both automata are walked together."""
        known = {w: i for i, w in enumerate(self.words)}
        names = np.array([known.get(w, -1) for w in asked.words] or [-1], np.int64)
        theirs, ours = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of states; -1: no such state here
        prefix, grams, weights = np.zeros((1, 0), np.int64), [], []
        for d in range(DEPTH):
            label, weight, target = asked.arcs[d]
            count = asked.size[d][theirs]
            at = _spans(asked.begin[d][theirs], count)
            here = np.repeat(ours, count)
            prefix = np.concatenate((np.repeat(prefix, count, axis=0), label[at][:, None]), axis=1)
            own_label, own_weight, own_target = self.arcs[d]
            owner = np.repeat(np.arange(len(self.size[d])), self.size[d])
            sought, keys = (here << 32) + names[label[at]], (owner << 32) + own_label
            spot = np.minimum(np.searchsorted(keys, sought), max(len(keys) - 1, 0))
            found = (here >= 0) & (names[label[at]] >= 0) & (keys[spot] == sought if len(keys) else False)
            has = weight[at] > 0
            grams.append(np.pad(prefix[has], ((0, 0), (0, DEPTH - d - 1)), constant_values=-1))
            weights.append(np.where(found, own_weight[spot] if len(keys) else 0, 0)[has])
            theirs, ours = target[at], np.where(found, own_target[spot] if len(keys) else -1, -1)
        order = np.lexsort(np.concatenate(grams).T[::-1])
        return np.concatenate(weights)[order]

    @classmethod
    def union(cls, parts: list[CountAutomaton], least: int = 1) -> tuple[CountAutomaton, int]:
        """One automaton with the summed weights, of which those under ``least`` are left out, and the number of words counted."""
        words = sorted(set().union(*[p.words for p in parts]))
        number = {w: i for i, w in enumerate(words)}
        grams, weights = [], []
        for p in parts:
            g, w = p.expand()
            names = np.array([*[number[x] for x in p.words], -1], np.int64)
            grams.append(names[g])
            weights.append(w)
        grams, weights = np.concatenate(grams), np.concatenate(weights)
        order = np.lexsort((grams[:, 2], (grams[:, 0] << 32) + grams[:, 1] + 1))
        grams, weights = grams[order], weights[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        grams, weights = grams[at], np.add.reduceat(weights, at) if len(at) else weights
        total = int(weights[grams[:, 1] < 0].sum())
        keep = weights >= least
        return cls.of(words, grams[keep], weights[keep]), total

    @classmethod
    def of(cls, words: list[bytes], grams: np.ndarray, weights: np.ndarray) -> CountAutomaton:
        """Like :meth:`from_sorted`, with only the words that occur."""
        used = np.zeros(len(words) + 1, bool)
        used[grams.ravel()] = True
        used[-1] = False
        names = np.append(np.cumsum(used[:-1]) - 1, -1)
        return cls.from_sorted([words[i] for i in np.flatnonzero(used[:-1]).tolist()], names[grams], weights)

    def to_bytes(self) -> bytes:
        out = [struct.pack("<q", len(self.words)), *_packed(np.array([len(w) for w in self.words], np.int64)), b"".join(self.words)]
        for d in range(DEPTH):
            for column in (*self.arcs[d], self.size[d]):
                out += _packed(column)
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountAutomaton:
        (n,), at = struct.unpack_from("<q", raw), 8
        lengths, at = _unpacked(raw, at)
        ends = (np.cumsum(lengths) + at).tolist()
        words = [raw[b - k : b] for b, k in zip(ends, lengths.tolist(), strict=True)]
        at = ends[-1] if n else at
        arcs, begin, size = [], [], []
        for _ in range(DEPTH):
            columns = []
            for _ in range(4):
                column, at = _unpacked(raw, at)
                columns.append(column)
            arcs.append(tuple(columns[:3]))
            size.append(columns[3])
            begin.append(np.cumsum(columns[3]) - columns[3])
        return cls(words, arcs, begin, size)


def _packed(column: np.ndarray) -> list[bytes]:
    """Length, width and values, as narrow as they fit."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<i8") if k == "<i8" or not len(column) or column.max() < 1 << 8 * int(k[2]))
    return [struct.pack("<qb", len(column), int(kind[2])), column.astype(kind).tobytes()]


def _unpacked(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width = struct.unpack_from("<qb", raw, at)
    kind = "<i8" if width == 8 else f"<u{width}"
    return np.frombuffer(raw, kind, n, at + 9).astype(np.int64), at + 9 + n * width
