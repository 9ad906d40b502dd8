"""Word and shingle hashes of many texts at once, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. Hashes are 64-bit polynomials over the bytes, mixed so that all bits depend on all bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SEGMENT = 1 << 20  # bytes hashed together, unless a single word is longer

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _doubled(table: np.ndarray, base: int, n: int) -> np.ndarray:
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n; kept for the next call."""
    global _powers, _inverses
    if len(_powers) < n:
        _powers = _doubled(_powers, _BASE, n)
        _inverses = _doubled(_inverses, _INVERSE, n)
    return _powers[:n], _inverses[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spaces(x: np.ndarray) -> np.ndarray:
    return (x == 0x20) | ((x >= 0x09) & (x <= 0x0D))


def marks(x: np.ndarray) -> np.ndarray:
    """ASCII bytes that are neither letter nor digit."""
    letter = ((x | 32) >= 97) & ((x | 32) <= 122)
    return ~letter & ~((x >= 48) & (x <= 57)) & (x < 128)


def _hash_segment(x: np.ndarray, lower: bool, gaps: Callable[[np.ndarray], np.ndarray] = spaces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of one byte array."""
    gap = np.concatenate([[True], gaps(x), [True]])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    if lower:
        x = np.where((x >= 65) & (x <= 90), x + np.uint8(32), x)
    power, inverse = powers(len(x))
    prefix = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power, out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def _segments(text: bytes) -> list[bytes]:
    """Parts of a long text, cut before white space."""
    parts, start = [], 0
    while len(text) - start > SEGMENT:
        at = next((i for i in range(start + SEGMENT, len(text)) if text[i] in b" \t\n\x0b\x0c\r"), len(text))
        parts.append(text[start:at])
        start = at
    return [*parts, text[start:]]


def hashed_words(texts: list[bytes], lower: bool = False, gaps: Callable[[np.ndarray], np.ndarray] = spaces) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): words of text i are hashes[offsets[i] : offsets[i + 1]]. gaps
    says which bytes separate words; white space must be among them."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[int] = []

    def flush() -> None:
        if not group:
            return
        sizes = np.array([len(texts[i]) + 1 for i in group])
        begin = np.cumsum(sizes) - sizes
        h, starts, _ = _hash_segment(np.frombuffer(b" ".join([texts[i] for i in group]), np.uint8), lower, gaps)
        counts[group] = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
        hashes.append(h)
        group.clear()

    held = 0
    for i, text in enumerate(texts):
        if len(text) > SEGMENT:
            flush()
            held = 0
            for part in _segments(text):
                h, _, _ = _hash_segment(np.frombuffer(part, np.uint8), lower, gaps)
                counts[i] += len(h)
                hashes.append(h)
            continue
        group.append(i)
        held += len(text)
        if held > SEGMENT:
            flush()
            held = 0
    flush()
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), offsets


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; a shorter, non-empty sequence is one shingle of its own."""
    size = min(k, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = h * np.uint64(_BASE) + words[j : j + n]
    return mix(h)
