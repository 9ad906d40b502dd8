"""Anchored windows of byte strings, in numpy.

Every window of ``size`` bytes has an anchor: the position of the smallest hash of a ``gram`` of
bytes among the grams inside it (the first, of equal ones). The anchor depends on the bytes of the
window alone, so equal windows have equal anchor grams at the same offset, wherever they stand.
Neighbouring windows mostly share their anchor; a run of them is one context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from convlens.llm.words import mix, powers

GRAM = 128
SEGMENT = 1 << 20  # window starts looked at together; positions fit in 20 bits


@dataclass
class Contexts:
    """Parallel arrays: text number, first window start, last window start, anchor position, anchor hash."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    power, inverse = powers(len(x))
    prefix = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power, out=prefix[1:])
    return mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(x) - gram + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima forward and backward in blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def _segment(data: bytes, begins: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(part, first, last, anchor, hash) of the windows inside the parts of data."""
    x = np.frombuffer(data, np.uint8)
    h = gram_hashes(x, gram)
    low = np.uint64((1 << 21) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_least(key, size - gram + 1) & low).astype(np.int64)
    counts = np.maximum(ends - begins - size + 1, 0)
    part = np.repeat(np.arange(len(begins)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[part]
    anchor = at[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    return part[new], start[new], start[last], anchor[new], h[anchor[new]]


def contexts(texts: list[bytes], size: int, gram: int = GRAM) -> Iterator[tuple[Contexts, bytes, np.ndarray]]:
    """Contexts of texts, in portions: (contexts, bytes of the portion, offset of each text's byte 0 in
    them). Positions in the contexts count within their text."""
    pending: list[tuple[int, int, bytes]] = []  # text, its byte at the start, bytes
    held = 0

    def portion() -> tuple[Contexts, bytes, np.ndarray]:
        data = b"".join([p[2] for p in pending])
        sizes = np.array([len(p[2]) for p in pending])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        part, first, last, anchor, h = _segment(data, begins, ends, size, gram)
        number = np.array([p[0] for p in pending])
        shift = begins - np.array([p[1] for p in pending])  # position in data less position in the text
        s = shift[part]
        return Contexts(number[part], first - s, last - s, anchor - s, h), data, s

    for i, text in enumerate(texts):
        if len(text) < size:
            continue
        for begin in range(0, len(text) - size + 1, SEGMENT):
            pending.append((i, begin, text[begin : begin + SEGMENT + size - 1]))
            held += len(pending[-1][2])
            if held >= SEGMENT // 2:
                yield portion()
                pending, held = [], 0
    if pending:
        yield portion()
