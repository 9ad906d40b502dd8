"""Hash-compared suffix sort, in numpy.

Suffixes are compared through prefix polynomial hashes: a binary search over the length finds their
longest common extension, and the byte behind it decides. A bottom-up mergesort places every suffix
by binary search in the run it is merged with, all runs of all classes at once. Neighbours that agree
over the whole length are verified byte by byte.
"""

from __future__ import annotations

import numpy as np

from convlens.llm.words import powers


class SuffixSort:
    def __init__(self, data: bytes, size: int):
        self.data, self.size = data, size
        self.x = np.frombuffer(data, np.uint8)
        power, self.inverse = powers(len(self.x) + 1)
        self.prefix = np.zeros(len(self.x) + 1, np.uint64)
        np.cumsum((self.x.astype(np.uint64) + np.uint64(1)) * power[: len(self.x)], out=self.prefix[1:])

    def _same(self, p: np.ndarray, q: np.ndarray, length) -> np.ndarray:
        a = (self.prefix[p + length] - self.prefix[p]) * self.inverse[p]
        b = (self.prefix[q + length] - self.prefix[q]) * self.inverse[q]
        return a == b

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes p and q, up to ``size``."""
        out = np.full(len(p), self.size, np.int64)
        rest = np.flatnonzero(~self._same(p, q, self.size))
        if len(rest):
            p, q = p[rest], q[rest]
            low, high = np.zeros(len(rest), np.int64), np.full(len(rest), self.size - 1, np.int64)
            for _ in range(self.size.bit_length()):
                middle = (low + high + 1) >> 1
                same = self._same(p, q, middle)
                low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
                high = np.maximum(low, high)
            out[rest] = low
        return out

    def compare(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair, over ``size`` bytes."""
        n = self.common(p, q)
        at = np.minimum(n, self.size - 1)
        a, b = self.x[p + at].astype(np.int16), self.x[q + at].astype(np.int16)
        return np.where(n == self.size, 0, np.sign(a - b))

    def sort(self, at: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """at: positions, class after class; start, length: of each position's class. Returns the
        positions with each class in order."""
        at = at.copy()
        place = np.arange(len(at)) - start
        width, longest = 1, int(length.max()) if len(at) else 0
        while width < longest:
            own = np.flatnonzero(length > width)  # classes that are one run by now are left alone
            i, s, n, p = place[own], start[own], length[own], at[own]
            run = i // width
            left = run % 2 == 0
            low = np.where(left, (run + 1) * width, (run - 1) * width)
            high = np.minimum(low + width, n)
            low = np.minimum(low, high)
            first, l, h = low.copy(), low, high
            todo = np.flatnonzero(l < h)
            while len(todo):
                m = (l[todo] + h[todo]) >> 1
                c = self.compare(at[s[todo] + m], p[todo])
                before = (c < 0) | ((c == 0) & ~left[todo])  # equal ones of the left run stay in front
                l[todo] = np.where(before, m + 1, l[todo])
                h[todo] = np.where(before, h[todo], m)
                todo = todo[l[todo] < h[todo]]
            new = (run // 2) * (2 * width) + i % width + (l - first)
            at[s + new] = p
            width *= 2
        return at

    def _verify(self, p: np.ndarray, q: np.ndarray) -> bool:
        """Are the bytes behind all pairs equal? Pairs that continue one another are compared at once."""
        order = np.lexsort((p, q - p))
        p, q = p[order], q[order]
        new = np.flatnonzero(np.concatenate([[True], (p[1:] - p[:-1] > 1) | (q[1:] - p[1:] != q[:-1] - p[:-1])]))
        last = np.append(new[1:], len(p)) - 1
        data, size = self.data, self.size
        return all(
            data[a : b + size] == data[c : d + size]
            for a, b, c, d in zip(p[new].tolist(), p[last].tolist(), q[new].tolist(), q[last].tolist())
        )

    def repeated(self, at: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """For each position: do ``size`` equal bytes start at another position of its class?
        klass: arrays of keys, compared as a whole, one row per key."""
        order = np.lexsort(klass)
        k = klass[:, order]
        new = np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)]) if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(at)))
        length_of, start_of = np.repeat(length, length), np.repeat(begin, length)
        own = np.flatnonzero(length_of > 1)
        out = np.zeros(len(at), bool)
        if not len(own):
            return out
        # classes of one are gone: starts count within the rest
        kept = length > 1
        starts = np.repeat(np.cumsum(length[kept]) - length[kept], length[kept])
        before = at[order[own]]
        ranked = self.sort(before, starts, length_of[own])
        same_class = starts[1:] == starts[:-1]
        pair = np.flatnonzero(same_class)
        equal = pair[self._same(ranked[pair], ranked[pair + 1], self.size)]
        if len(equal) and not self._verify(ranked[equal], ranked[equal + 1]):
            return self._by_bytes(at, klass)
        flag = np.zeros(len(own), bool)
        flag[equal] = True
        flag[equal + 1] = True
        flagged = np.sort(ranked[flag])
        hit = np.searchsorted(flagged, before)
        hit = np.minimum(hit, max(0, len(flagged) - 1))
        out[order[own]] = flagged[hit] == before if len(flagged) else False
        return out

    def _by_bytes(self, at: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """The same without hashes, for the day two different strings share one."""
        names = [(*k, self.data[p : p + self.size]) for p, k in zip(at.tolist(), klass.T.tolist())]
        seen: dict = {}
        for n in names:
            seen[n] = seen.get(n, 0) + 1
        return np.array([seen[n] > 1 for n in names])
