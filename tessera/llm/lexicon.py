"""A frozen lexicon: words compiled into a minimal acyclic automaton whose words carry lists of ids.

States with equal futures are shared (suffix sharing), so outputs cannot hang on states. Each arc instead holds how
many words sort before the words behind it; summed along a word these counts give the word's number, and the number
its list of ids. The arcs lie in one open-addressed table, the whole in one file, which executors memory-map.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio: Fibonacci hashing


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def compile_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The arcs of the minimal automaton of sorted, different, non-empty words, and the bitmap of final states.

    An arc is a row (key = state * 256 + byte, target, words before it). State 0 is the start.
    """
    register: dict[tuple, int] = {}
    final, counts, kids = [False], [0], [()]  # of the frozen states; state 0 is set last
    path: list[list] = [[False, []]]  # states of the last word that may still grow: [final, [(byte, state)]]

    def freeze(down_to: int) -> None:
        while len(path) > down_to:
            end, arcs = path.pop()
            key = (end, tuple(arcs))
            state = register.get(key)
            if state is None:
                state = register[key] = len(final)
                final.append(end)
                kids.append(key[1])
                counts.append(end + sum(counts[s] for _, s in arcs))
            path[-1][1].append((pending[len(path) - 1], state))

    pending: bytes = b""
    for word in words:
        common = 0
        for a, b in zip(pending, word):
            if a != b:
                break
            common += 1
        freeze(common + 1)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        pending = word
    freeze(1)
    final[0], kids[0] = path[0][0], tuple(path[0][1])
    arcs = []
    for state, out in enumerate(kids):
        before = int(final[state])
        for byte, target in out:
            arcs.append((state * 256 + byte, target, before))
            before += counts[target]
    return np.array(arcs, np.int64).reshape(-1, 3), np.array(final, bool)


def _table(arcs: np.ndarray) -> np.ndarray:
    bits = max(4, int(np.ceil(np.log2(max(1, len(arcs)) * 2))))
    out = np.full((1 << bits, 3), -1, np.int64)
    left, slot = np.arange(len(arcs)), _slot(arcs[:, 0].astype(np.uint64), bits)
    while len(left):
        free = out[slot, 0] < 0
        out[slot[free]] = arcs[left[free]]  # of several claims to a slot the last one holds
        lost = out[slot, 0] != arcs[left, 0]
        left, slot = left[lost], (slot[lost] + 1) & ((1 << bits) - 1)
    return out


def compiled(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file for Lexicon of (word, ids) pairs."""
    pairs = sorted({w: ids for w, ids in words if w}.items())
    arcs, final = compile_automaton([w for w, _ in pairs])
    table = _table(arcs)
    ends = np.cumsum([0, *(len(ids) for _, ids in pairs)], dtype=np.int64)
    ids = np.array([i for _, own in pairs for i in own], np.int64)
    parts = (np.array([len(table), len(final), len(ends), len(ids)], np.int64), table.ravel(), final.astype(np.int64), ends, ids)
    return b"".join(x.tobytes() for x in parts)


class Lexicon:
    def __init__(self, path: str):
        raw = np.memmap(path, np.int64, "r")
        sizes = [int(x) for x in raw[:4]]
        cuts = np.cumsum([4, 3 * sizes[0], *sizes[1:]])
        self.table = raw[cuts[0] : cuts[1]].reshape(-1, 3)
        self.final, self.ends, self.ids = (raw[a:b] for a, b in zip(cuts[1:-1], cuts[2:]))
        self.bits = sizes[0].bit_length() - 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the lexicon lacks it. All words walk the automaton together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live, step, mask = np.flatnonzero(size > 0), 0, (1 << self.bits) - 1
        number[size == 0] = -1
        while len(live):
            key = state[live] * 256 + flat[start[live] + step]
            slot, target, before = _slot(key.astype(np.uint64), self.bits), np.full(len(live), -1), np.zeros(len(live), np.int64)
            open_ = np.arange(len(live))
            while len(open_):
                arc = self.table[slot[open_]]
                hit = arc[:, 0] == key[open_]
                target[open_[hit]], before[open_[hit]] = arc[hit, 1], arc[hit, 2]
                open_ = open_[~hit & (arc[:, 0] >= 0)]
                slot[open_] = (slot[open_] + 1) & mask
            number[live] = np.where(target < 0, -1, number[live] + before)
            state[live] = target
            step += 1
            live = live[target >= 0]
            ended = size[live] == step
            bad = live[ended & (self.final[state[live]] == 0)]
            number[bad] = -1
            live = live[~ended]
        return number

    def get(self, number: int) -> np.ndarray:
        return self.ids[self.ends[number] : self.ends[number + 1]]
