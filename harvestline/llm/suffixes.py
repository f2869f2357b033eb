"""Suffix arrays of byte strings, their common prefixes, and the windows that occur more than once.

`suffix_array` refines groups of equal ranks by doubling, as Larsson and Sadakane do: suffixes that are alone in their group
leave the sorting.  `common_prefixes` follows Kasai: from one position to the next the common prefix with the neighbour
in the array shrinks by one at most; all pieces of the buffer are walked side by side.  `repeated_windows` does so for each
shard of the pieces and then merges shards by binary search of each one's windows in the others' arrays.
"""

from __future__ import annotations

import numpy as np

SHARD_BYTES = 1 << 20


def _words(buffer: np.ndarray, big: bool) -> np.ndarray:
    """The eight bytes from each position on as one number; the buffer ends with at least 8 bytes of padding."""
    n = len(buffer) - 8
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out |= buffer[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j if big else 8 * j)
    return out


def suffix_array(buffer: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that begin there."""
    n = len(buffer)
    if not n:
        return np.zeros(0, np.int64)
    words = _words(np.concatenate([buffer, np.zeros(8, np.uint8)]), big=True)
    order = np.argsort(words, kind="stable")
    fresh = np.append(True, words[order][1:] != words[order][:-1])
    group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # a group's rank is the place of its first member
    rank = np.empty(n, np.int64)
    rank[order] = group
    length = 8
    while True:
        alone = np.append(fresh[1:], True) & fresh
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        members = order[open_]
        behind = members + length
        follow = np.where(behind < n, rank[np.minimum(behind, n - 1)], n - 1 - behind)  # past the end: the shorter first
        place = np.argsort(rank[members] * (n + length + 1) + follow + length, kind="stable")
        members, follow = members[place], follow[place]
        old = rank[members]
        order[open_] = members
        parted = np.append(True, (old[1:] != old[:-1]) | (follow[1:] != follow[:-1]))
        fresh[open_] = parted
        rank[members] = open_[np.flatnonzero(parted)][np.cumsum(parted) - 1]
        length *= 2
    return order


def common_prefixes(buffer: np.ndarray, order: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to `limit`, of the common prefix of each entry of `order` with the entry before it."""
    n = len(buffer)
    words = _words(np.concatenate([buffer, np.zeros(limit + 16, np.uint8)]), big=False)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(n, np.int64)
    sizes = np.diff(np.append(starts, n))
    lanes = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[lanes], sizes[lanes]
    kept = np.zeros(len(starts), np.int64)
    for step in range(int(sizes.max(initial=0))):
        alive = int(np.searchsorted(-sizes, -step, "left"))
        at = starts[:alive] + step
        other = before[at]
        height = np.maximum(kept[:alive] - 1, 0)
        todo = np.flatnonzero(other >= 0)
        height[other < 0] = 0
        while len(todo):
            differ = words[at[todo] + height[todo]] ^ words[other[todo] + height[todo]]
            # Bytes that agree: those below the lowest bit that differs.
            agree = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8)
            height[todo] += agree
            todo = todo[(agree == 8) & (height[todo] < limit)]
        height = np.minimum(height, limit)
        kept[:alive] = height
        prefix[at] = height
    return prefix[order]


class _Shard:
    """Pieces in one buffer, with the windows that lie inside a piece in suffix order."""

    def __init__(self, pieces: list[bytes], width: int):
        self.width = width
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        order = suffix_array(self.buffer)
        shared = common_prefixes(self.buffer, order, self.starts, width)
        whole = np.ones(len(self.buffer), bool)
        for back in range(1, min(width, int(sizes.max(initial=0)) + 1)):
            whole[self.ends[sizes >= back] - back] = False
        inside = np.flatnonzero(whole[order])
        self.windows = order[inside]
        self.repeated = np.zeros(len(self.buffer), bool)
        if len(inside) > 1:
            # Between two neighbouring windows the least prefix on the way counts.
            least = np.minimum.reduceat(shared, inside[:-1] + 1)
            last = shared[inside[-1]] if inside[-2] + 1 == inside[-1] else min(shared[inside[-2] + 1 : inside[-1] + 1])
            least[-1] = last
            same = least >= width
            self.repeated[self.windows[:-1][same]] = True
            self.repeated[self.windows[1:][same]] = True
        self.words = _words(np.concatenate([self.buffer, np.zeros(16, np.uint8)]), big=True)

    def _order(self, at: np.ndarray, other: _Shard, there: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the window at `at` comes before, equals or follows the one at `there` of the other shard."""
        out = np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        for step in range(0, self.width, 8):
            step = min(step, self.width - 8)
            a, b = self.words[at[todo] + step], other.words[there[todo] + step]
            out[todo] = (a > b).astype(np.int64) - (a < b)
            todo = todo[a == b]
            if not len(todo):
                break
        return out

    def merge(self, other: _Shard) -> None:
        """Marks the windows that both shards have, by binary search."""
        if not len(self.windows) or not len(other.windows):
            return
        low, high = np.zeros(len(self.windows), np.int64), np.full(len(self.windows), len(other.windows))
        while (active := np.flatnonzero(low < high)).size:
            middle = (low[active] + high[active]) // 2
            after = self._order(self.windows[active], other, other.windows[middle]) > 0
            low[active[after]] = middle[after] + 1
            high[active[~after]] = middle[~after]
        found = np.flatnonzero(low < len(other.windows))
        found = found[self._order(self.windows[found], other, other.windows[low[found]]) == 0]
        self.repeated[self.windows[found]] = True


def repeated_windows(pieces: list[bytes], width: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each piece, a flag for each of its windows of `width` bytes (8 or more): does the window start anywhere else in the pieces?"""
    shards: list[tuple[int, _Shard]] = []
    start = size = 0
    for i, piece in enumerate([*pieces, None]):
        if piece is None or (i > start and size + len(piece) > shard_bytes):
            if i > start:
                shards.append((start, _Shard(pieces[start:i], width)))
            start, size = i, 0
        size += len(piece or b"")
    for _, one in shards:
        for _, other in shards:
            if one is not other:
                one.merge(other)
    return [s.repeated[a : max(a, b - width + 1)] for _, s in shards for a, b in zip(s.starts, s.ends)]
