"""Near-duplicate passages by compact windows.

A text is the sequence of its word shingles. Under one min-hash function the shingle with the
smallest value inside a passage is the passage's signature. All passages of at least ``T`` shingles
with the same smallest shingle form one compact window: the node of the Cartesian tree over the
values, from the next smaller value on its left to the next smaller one on its right. A text of n
shingles has about 2 n / T of them, and they cover every passage. Trees are built level by level for
many texts at once.

Windows of one signature are joined by interval: around the shared shingle, both sides as far as the
two windows reach (T - 1 shingles at most; longer passages have more windows). Windows equal over
that interval hold the same passage. The others are first compared by bits, narrow rows that bound the number of shared
shingles from above; only those that may share enough with another one fetch their shingles. Of these each meets every one before it in its signature
that shares enough shingles with it, and the pair is verified: the shingle sets of some two passages
around the shared one, of at least ``MIN_WORDS`` words, need a Jaccard similarity of ``PERCENT``. ``HASHES`` functions are joined that way; a passage
counts once any of them finds it, since every find is verified.

What stays: the occurrence with the smallest key (a hash of id and text) and position. Every passage
that is removed has one before it, so no passage vanishes altogether.

A signature may be as frequent as it likes: equal windows collapse in the task that reads them, and
the rest of a long one is compared block with block across tasks.

Defined results: null, empty and short texts have no passage; rows that repeat a text are passages
of one another (rows equal in id and text count as one row); a text of any length is read whole; null ids are passed through; an
empty table gives no rows; columns beside id and text are kept by ``without_passages`` and not read
otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convlens.llm.words import hashed_words, mix, powers, shingle_hashes
from convlens.sources.staging import stage

WORDS = 5
MIN_WORDS = 50
PERCENT = 80
HASHES = 3
T = MIN_WORDS - WORDS + 1
SKETCH = 512  # bits that stand for the shingles of an interval (at most 2 T - 1) until a pair may share a passage
AHEAD = 32  # candidates of a window looked at together, those that share most first
BLOCK = 1024  # windows of a signature compared with as many others in one task
_BITS = 21
_LOW = np.uint64((1 << _BITS) - 1)
_SPREAD = 0x1F35BD  # odd: multiplying by it permutes the numbers below 2 ** 21
_GATHER = pow(_SPREAD, -1, 1 << _BITS)
_GROUP = 1 << 20  # bytes of text looked at together
_PIECE = 1 << 20  # shingles of a long text looked at together
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def compact_windows(values: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(number of the range, first, centre, last) of the compact windows of at least ``width`` values
    in the ranges [begin, end). Of equal values one at a scattered place is the smallest, so that trees
    over repetitive text stay shallow."""
    if not len(values):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    size = end - begin
    place = np.zeros(len(values), np.int64)  # within the range
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place[inside + np.repeat(begin, size)] = inside
    low = (place.astype(np.uint64) * np.uint64(_SPREAD)) & _LOW
    keys = np.append((values & ~_LOW) | low, np.iinfo(np.uint64).max)
    number, lo, hi = np.arange(len(begin)), begin.astype(np.int64), end.astype(np.int64) - 1
    out = []
    while True:
        wide = hi - lo + 1 >= width
        number, lo, hi = number[wide], lo[wide], hi[wide]
        if not len(lo):
            break
        order = np.argsort(lo, kind="stable")
        number, lo, hi = number[order], lo[order], hi[order]
        cuts = np.stack([lo, hi + 1], axis=1).ravel()
        least = np.minimum.reduceat(keys, cuts)[::2]
        centre = begin[number] + ((least & _LOW) * np.uint64(_GATHER) & _LOW).astype(np.int64)
        out.append((number, lo, centre, hi))
        number = np.concatenate([number, number])
        lo, hi = np.concatenate([lo, centre + 1]), np.concatenate([centre - 1, hi])
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def _ranges(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the shingle ranges of texts whose words lie at offsets ``at``; long texts
    are cut into ranges that overlap by the longest interval."""
    text, begin, end = [], [], []
    count = np.diff(at) - WORDS + 1
    for i in np.flatnonzero(count >= T):
        for b in range(0, int(count[i]), _PIECE):
            text.append(i), begin.append(at[i] + b), end.append(min(at[i] + b + _PIECE + 2 * T, at[i] + count[i]))
    return np.array(text, np.int64), np.array(begin, np.int64), np.array(end, np.int64)


def text_windows(texts: list[bytes], hashes: int = HASHES) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, signature, interval hash, centre shingle, reach left, reach right) for groups of texts."""
    words, at = hashed_words(texts, lower=True)
    shingles = shingle_hashes(words, WORDS) if len(words) >= WORDS else np.zeros(0, np.uint64)
    text, begin, end = _ranges(at)
    # ranges that fit in the numbers a key can hold are looked at together
    start = 0
    while start < len(text):
        stop = start + 1
        while stop < len(text) and end[stop] - begin[start] < (1 << _BITS) - 1:
            stop += 1
        base, own = begin[start], slice(start, stop)
        part = shingles[base : end[own].max()]
        power, inverse = powers(len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=prefix[1:])
        for f in range(hashes):
            values = mix(part ^ mix(np.full(1, f + 1, np.uint64)))
            # overlapping ranges (of one long text) must not share values: each gets its own pass
            b, e = begin[own] - base, end[own] - base
            passes = [np.arange(len(b))] if len(b) < 2 or (b[1:] >= e[:-1]).all() else [np.array([i]) for i in range(len(b))]
            for chosen in passes:
                number, lo, c, hi = compact_windows(values, b[chosen], e[chosen], T)
                left, right = np.minimum(c - lo, T - 1), np.minimum(hi - c, T - 1)
                span = (prefix[c + right + 1] - prefix[c - left]) * inverse[c - left]
                reach = (left * 256 + right).astype(np.uint64)
                owner = text[own][chosen][number]
                yield owner, mix(values[c] + np.uint64(f)), mix(span + mix(reach)), c + base - at[owner], left, right
        start = stop


def _pack(c: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (c.astype(np.int64) << 16) | (left << 8) | right


def _windows(keyed: DataFrame, hashes: int) -> DataFrame:
    """key, sig, h, pos, source_pos. A window that equals one before it in its batch has that one's place
    as source_pos and its key as h; its own sig is a number that no other window has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "sig", "h", "pos", "source_pos"]
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), _texts(batch.column(1))
            parts, group, held = [], [], 0
            for i, t in enumerate([*texts, None]):
                if t is None or (held and held + len(t) > _GROUP):
                    first = i - len(group)
                    parts += [(keys[first + o], s, h, _pack(c, lt, rt)) for o, s, h, c, lt, rt in text_windows(group, hashes)]
                    group, held = [], 0
                if t is not None:
                    group.append(t)
                    held += len(t)
            if not parts:
                continue
            key, sig, h, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((pos, key, h, sig))
            key, sig, h, pos = key[order], sig[order], h[order], pos[order]
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (h[1:] != h[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            alone = mix(key.view(np.uint64) ^ mix(sig + pos.view(np.uint64)))
            sig, h = np.where(new, sig, alone).view(np.int64), np.where(new, h.view(np.int64), key[first])
            columns = [pa.array(key), pa.array(sig), pa.array(h), pa.array(pos), pa.array(pos[first], mask=new)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return keyed.select("key", "text").mapInArrow(run, "key long, sig long, h long, pos long, source_pos long")


def _span(pos: str, end: bool = False):
    centre = F.shiftright(F.col(pos), 16)
    if end:
        return centre + F.col(pos).bitwiseAND(255) + WORDS
    return centre - F.shiftright(F.col(pos), 8).bitwiseAND(255)


def _equal_spans(rows: DataFrame) -> DataFrame:
    """rows: key, pos, source, source_pos. Word spans of passages that equal one before them; two places
    in one text must not overlap."""
    apart = (F.col("key") != F.col("source")) | (_span("pos") >= _span("source_pos", end=True))
    return rows.where(apart).select("key", F.array("source").alias("sources"), _span("pos").alias("begin"), _span("pos", end=True).alias("end"))


def _with_texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: key, sig, pos. One row per text that is wanted: key, text, own (sig, pos)."""
    per_text = wanted.groupBy("key").agg(F.collect_set(F.struct("sig", "pos")).alias("own"))
    return keyed.select("key", "text").dropDuplicates(["key"]).join(per_text, "key").select("key", "text", "own")


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of rows of ``_with_texts``, in groups: key, sig, pos, (shingles, first, number) of the intervals."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            words, at = hashed_words(_texts(part.column(1)), lower=True)
            shingles = shingle_hashes(words, WORDS) if len(words) >= WORDS else np.zeros(0, np.uint64)
            own = part.column(2)
            count = np.asarray(pa.compute.list_value_length(own))
            fields = own.flatten()
            sig, pos = (np.asarray(fields.field(i)) for i in range(2))
            owner = np.repeat(np.arange(part.num_rows), count)
            key = part.column(0).to_numpy()[owner]
            left, right = (pos >> 8) & 255, pos & 255
            yield key, sig, pos, shingles, at[owner] + (pos >> 16) - left, left + right + 1


def _slices(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: key, sig, pos. The same with the shingles of the interval, as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sig, pos, shingles, first, number in _intervals(batches):
            data = [shingles[a : a + n].tobytes() for a, n in zip(first, number)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sig), pa.array(pos), pa.array(data, pa.binary())], names=["key", "sig", "pos", "shingles"])

    return _with_texts(keyed, wanted).mapInArrow(run, "key long, sig long, pos long, shingles binary")


def interval_bits(shingles: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SKETCH bits in 64-bit words, shingles beyond the bits set) of intervals. Two intervals share no more shingles than
    bits, and the smaller of their second numbers besides."""
    row = np.repeat(np.arange(len(first)), number)
    at = np.arange(len(row)) - np.repeat(np.cumsum(number) - number - first, number)
    bits = np.zeros((len(first), SKETCH), bool)
    bits[row, (mix(shingles[at]) >> np.uint64(32)) % np.uint64(SKETCH)] = True
    return np.packbits(bits, axis=1).view(np.uint64), number - bits.sum(axis=1)


def sharing(sig: np.ndarray, bits: np.ndarray, beyond: np.ndarray, least: int) -> np.ndarray:
    """Which rows may share ``least`` shingles with another of their signature; rows in order of it."""
    may, near = np.zeros(len(sig), bool), np.arange(len(sig))
    for d in range(1, len(sig)):
        near = near[: np.searchsorted(near, len(sig) - d)]
        near = near[sig[near] == sig[near + d]]
        if not len(near):
            break
        same = near[~(may[near] & may[near + d])]  # of two that may, nothing is left to find
        shared = np.bitwise_count(bits[same] & bits[same + d]).sum(axis=1) + np.minimum(beyond[same], beyond[same + d])
        found = same[shared >= least]
        may[found] = may[found + d] = True
    return may


def _dealt(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """rows: sig, key, pos and more. With b1, b2 and block: the rows of a signature (counted in signatures) of at
    most ``BLOCK`` have zeros, those of a longer one come once for each pair of its blocks."""
    hot = stage(signatures.where(F.col("count") > BLOCK).select("sig", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "passages-blocks")
    dealt = rows.join(hot, "sig", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("key", "pos"), F.col("blocks")), F.lit(0)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other")).drop("other", "blocks")
    return dealt.repartition("sig", "b1", "b2")


def _sharing(keyed: DataFrame, wanted: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """wanted: key, sig, pos. Those that may share a passage with another one of their signature, judged by
    bits in place of shingles: none that does is left out. Those of a long signature may come repeatedly."""
    least = T * percent // 100

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sig, pos, shingles, first, number in _intervals(batches):
            for start in range(0, len(key), 8192):
                own = slice(start, start + 8192)
                bits, beyond = interval_bits(shingles, first[own], number[own])
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH // 8), len(bits), [None, pa.py_buffer(bits.tobytes())])
                columns = [pa.array(key[own]), pa.array(sig[own]), pa.array(pos[own]), pa.array(beyond, pa.int32()), data.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "sig", "pos", "beyond", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(rows: pa.Table) -> np.ndarray:
            sig, b1, b2 = (rows.column(c).to_numpy() for c in ("sig", "b1", "b2"))
            new = (sig[1:] != sig[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
            return np.concatenate([[0], np.cumsum(new)])

        def met(rows: pa.Table) -> pa.RecordBatch:
            key, sig, pos, beyond = (rows.column(c).to_numpy() for c in ("key", "sig", "pos", "beyond"))
            bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
            may = sharing(groups(rows), bits, beyond, least)
            return pa.RecordBatch.from_arrays([pa.array(x[may]) for x in (key, sig, pos)], names=["key", "sig", "pos"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            if not held.num_rows:
                continue
            number = groups(held)
            whole = int(np.searchsorted(number, number[-1]))  # the last one may go on
            if whole:
                yield met(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield met(held)

    rows = _with_texts(keyed, wanted).mapInArrow(sketches, "key long, sig long, pos long, beyond int, bits binary")
    return _dealt(rows, signatures).sortWithinPartitions("sig", "b1", "b2").mapInArrow(run, "key long, sig long, pos long")


def _side(x: list[int], y: list[int], ix: int, iy: int, step: int) -> tuple[np.ndarray, ...]:
    """(distance from the centre, distinct shingles up to there) of the places where stretches of x may
    end on one side, the same of y, and how many of these shingles both hold. Stretches end where a run
    of shared shingles does: one more shared shingle on both sides never lowers the similarity, and one
    that has come before changes nothing."""
    sides = []
    for z, k in ((x, ix), (y, iy)):
        own = z[k + 1 :] if step > 0 else z[:k][::-1]
        first = dict.fromkeys(own)
        first.pop(z[k], None)
        at, seen = [0], {z[k]}
        for i, v in enumerate(own):
            if v in seen:
                at[-1] = i + 1
            else:
                seen.add(v)
                at.append(i + 1)
        sides.append((list(first), at))
    (own, at_x), (other, at_y) = sides
    place = {v: j for j, v in enumerate(other)}
    pairs = [(i, place[v]) for i, v in enumerate(own) if v in place]
    met = set(pairs)
    begins = (0, 0) not in met
    ends_x = sorted({i + 1 for i, j in pairs if (i + 1, j + 1) not in met} | ({0} if begins or not pairs else set()))
    ends_y = sorted({j + 1 for i, j in pairs if (i + 1, j + 1) not in met} | ({0} if begins or not pairs else set()))
    i, j = np.array(pairs, np.int64).reshape(-1, 2).T
    ex, ey = np.array(ends_x), np.array(ends_y)
    both = (i[:, None] < ex).T.astype(np.int32) @ (j[:, None] < ey).astype(np.int32)
    return np.array(at_x)[ex], ex, np.array(at_y)[ey], ey, both


def _outermost(x: list[int], y: list[int], ix: int, iy: int) -> tuple[int, int]:
    """First and last place of x, around ix, of a shingle that y holds on the same side of iy; none is repeated."""
    before, behind = set(y[:iy]), set(y[iy + 1 :])
    first = next((i for i in range(ix) if x[i] in before), ix)
    return first, next((i for i in range(len(x) - 1, ix, -1) if x[i] in behind), ix)


def shared_passage(x: list[int], ix: int, y: list[int], iy: int, percent: int = PERCENT, width: int = T) -> tuple[int, int, int, int] | None:
    """Ends (inclusive) of the widest passages of x and y around the shingle they share at ix and iy that
    have at least ``width`` shingles and the similarity, or None.

    All stretches that end where runs of shared shingles end are tried; one that is too short is filled
    up with the shingles beside it, shared or not (a word changed near the end of a short passage).
    """
    left = 0
    while left < min(ix, iy) and x[ix - left - 1] == y[iy - left - 1]:
        left += 1
    right, most = 0, min(len(x) - ix, len(y) - iy) - 1
    while right < most and x[ix + right + 1] == y[iy + right + 1]:
        right += 1
    verbatim = (ix - left, ix + right, iy - left, iy + right) if left + right + 1 >= width else None
    sx, sy = set(x), set(y)
    both = sx & sy
    if len(both) < width * percent // 100 and not verbatim:
        return None
    if verbatim and both <= set(x[ix - left : ix + right + 1]):
        return verbatim
    less_x, less_y = len(x) - len(sx), len(y) - len(sy)
    if (100 + percent) * len(both) < percent * (2 * width - less_x - less_y) and not verbatim:
        return None
    if not less_x and not less_y and not verbatim:
        # the similarity asks for (100 + percent) * shared >= percent * (size of x + size of y), and shared is at
        # most the mean of the shared ones on both sides
        best = [_most(np.array([[v in both for v in z]]), k, 100 - percent, -2 * percent, width)[0] for z, k in ((x, ix), (y, iy))]
        if sum(best) < 0:
            return None
    if not less_x and not less_y:
        a, c, b, d = *_outermost(x, y, ix, iy), *_outermost(y, x, iy, ix)
        if min(c - a, d - b) + 1 >= width:
            if verbatim and c - a <= left + right:
                return verbatim
            n = len(set(x[a : c + 1]) & set(y[b : d + 1]))
            if 100 * n >= percent * (c - a + d - b + 2 - n):
                return a, c, b, d
    lx, dlx, ly, dly, on_left = _side(x, y, ix, iy, -1)
    rx, drx, ry, dry, on_right = _side(x, y, ix, iy, 1)
    size_x, size_y = lx[:, None] + rx + 1, ly[:, None] + ry + 1
    # no more shingles are shared and no fewer held than this: the same one may stand on both sides of
    # the centre; filling only adds what is not shared, for stretches end where shared runs do
    fill_x, fill_y = np.maximum(width - size_x, 0), np.maximum(width - size_y, 0)
    hold_x = np.maximum(dlx[:, None] + drx + 1 + fill_x - less_x, 1)[:, None, :, None]
    hold_y = np.maximum(dly[:, None] + dry + 1 + fill_y - less_y, 1)[None, :, None, :]
    more = max(0, len(both) - int(on_left.max() + on_right.max()) - 1)
    shared = on_left[:, :, None, None] + on_right[None, None] + (1 + more)
    shared = np.minimum(shared, len(both))
    fine = np.argwhere((100 + percent) * shared >= percent * (hold_x + hold_y))
    order = fine[np.lexsort((-size_y[fine[:, 1], fine[:, 3]], -size_x[fine[:, 0], fine[:, 2]]))]
    for i, j, k, m in order:
        if verbatim and lx[i] + rx[k] <= left + right:
            break
        for a, c in _filled(int(ix - lx[i]), int(ix + rx[k]), len(x), width):
            sx = set(x[a : c + 1])
            for b, d in _filled(int(iy - ly[j]), int(iy + ry[m]), len(y), width):
                sy = set(y[b : d + 1])
                n = len(sx & sy)
                if 100 * n >= percent * (len(sx) + len(sy) - n):
                    return a, c, b, d
    return verbatim


def _filled(first: int, last: int, n: int, width: int) -> list[tuple[int, int]]:
    """The stretches of ``width`` shingles (of those below n) that hold first to last, or that one itself."""
    if last - first + 1 >= width:
        return [(first, last)]
    return [(a, a + width - 1) for a in range(max(0, last - width + 1), min(first, n - width) + 1)]


def _shared_counts(rows: list[tuple]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(columns of the places of each row, -1 for a shingle of one row only; rows by columns: where in the row, -1 if
    nowhere; shingles that two rows share; whether a row repeats none) of rows whose fourth field holds shingles."""
    sizes = np.array([len(r[3]) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    _, column = np.unique(np.concatenate([np.asarray(r[3], np.uint64) for r in rows]), return_inverse=True)
    pairs, at = np.unique(column * len(rows) + row, return_index=True)
    several = np.bincount(pairs // len(rows)) > 1
    number = np.where(several, np.cumsum(several) - 1, -1)
    place = np.full((len(rows), int(several.sum())), -1, np.int8 if sizes.max() < 128 else np.int16)
    chosen = several[pairs // len(rows)]
    inside = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[at]
    place[pairs[chosen] % len(rows), number[pairs[chosen] // len(rows)]] = inside[chosen]
    counts = np.zeros((len(rows), len(rows)), np.float32)
    for start in range(0, place.shape[1], 4096):
        part = (place[:, start : start + 4096] >= 0).astype(np.float32)
        counts += part @ part.T
    distinct = np.bincount(pairs % len(rows), minlength=len(rows)) == sizes
    return np.split(number[column], np.cumsum(sizes)[:-1]), place, counts, distinct


def _most(shared: np.ndarray, centre: int, hit: int, miss: int, width: int) -> np.ndarray:
    """shared: rows of flags along an interval. The largest sum of some ``width`` or more of them in a
    row around the centre, where a set one counts ``hit`` and another one ``miss``."""
    sums = np.zeros((len(shared), shared.shape[1] + 1), np.int32)
    np.cumsum(np.where(shared, hit, miss), axis=1, out=sums[:, 1:])
    ends = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1]  # the largest sum from here on
    begin = np.arange(min(centre, shared.shape[1] - width) + 1)
    return (ends[:, np.maximum(begin + width, centre + 1)] - sums[:, begin]).max(axis=1)


def _dense(shared: np.ndarray, centre: int, percent: int, width: int = T) -> np.ndarray:
    """Whether ``percent`` of the flags of some stretch are set, as a passage without repeated shingles
    needs for its similarity."""
    return _most(shared, centre, 100 - percent, -percent, width) >= 0


def _reach(shared: np.ndarray, centre: int, percent: int, width: int = T) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of all stretches together that ``_dense`` finds; each row has one."""
    n = shared.shape[1]
    sums = np.zeros((len(shared), n + 1), np.int32)
    np.cumsum(np.where(shared, 100 - percent, -percent), axis=1, out=sums[:, 1:])
    best_end = np.maximum.accumulate(sums[:, ::-1], axis=1)[:, ::-1]
    best_begin = np.minimum.accumulate(sums, axis=1)
    begin, end = np.arange(min(centre, n - width) + 1), np.arange(max(centre + 1, width), n + 1)
    from_here = best_end[:, np.maximum(begin + width, centre + 1)] >= sums[:, begin]
    up_to_here = sums[:, end] >= best_begin[:, np.minimum(end - width, centre)]
    return from_here.argmax(axis=1), n - up_to_here[:, ::-1].argmax(axis=1)


def _both_reach(place: np.ndarray, centre: int, percent: int, width: int = T) -> tuple[np.ndarray, ...]:
    """place: where the shingles of an interval stand in other ones (a row each), -1 if nowhere. First place and
    end of what stretches with the similarity can share with each, equal ones if nothing; and whether that holds,
    as it does where both have the shared ones in one order. No interval repeats a shingle.

    The shared shingles from i to j are at most those between, and the stretches hold at least what lies between on
    either side: (100 + percent) * shared >= percent * (size on one side + size on the other) parts into a sum for i and one for j.
    """
    shared = place >= 0
    ordered = (~shared | (place == np.maximum.accumulate(place, axis=1))).all(axis=1)
    count = np.cumsum(shared, axis=1, dtype=np.int32)
    sums = (100 + percent) * count - percent * (np.arange(place.shape[1], dtype=np.int32) + place)
    slack = 2 * percent - (100 + percent)
    begins, ends = np.where(shared[:, : centre + 1], sums[:, : centre + 1], 1 << 30), np.where(shared[:, centre:], sums[:, centre:], -(1 << 30))
    from_here = ends.max(axis=1)[:, None] >= begins + slack
    up_to_here = ends >= begins.min(axis=1)[:, None] + slack
    low, high = from_here.argmax(axis=1), place.shape[1] - up_to_here[:, ::-1].argmax(axis=1)
    row = np.arange(len(place))
    enough = (100 + percent) * (count[row, high - 1] - count[row, low] + 1) >= 2 * percent * width
    some = from_here.any(axis=1) & up_to_here.any(axis=1) & enough
    return np.where(some, low, 0), np.where(some, high, 0), ordered


def group_spans(rows: list[tuple], blocks: list[int], percent: int) -> list[tuple]:
    """(key, sources, begin, end) of the windows of one signature, or of two of its blocks: what each has in passages
    that it shares with rows before it, and keys of such rows. rows: (key, first shingle, place of the centre,
    shingles) in order of key and place.

    Each row meets every one before it that shares enough shingles, those with most uncovered ones
    first; a pair is left out only if no passage of it can hold a shared shingle beyond those verified before.
    """
    lists: dict[int, list[int]] = {}  # shingles of the rows that are verified

    def listed(i: int) -> list[int]:
        if i not in lists:
            lists[i] = np.asarray(rows[i][3], np.uint64).tolist()
        return lists[i]

    if len(rows) == 2:
        other, own = rows
        found = shared_passage(listed(1), own[2], listed(0), other[2], percent)
        if found and (own[0] != other[0] or other[1] + found[3] + WORDS <= own[1] + found[0]):
            return [(own[0], [other[0]], own[1] + found[0], own[1] + found[1] + WORDS)]
        return []
    out: list[tuple] = []
    columns, places, counts, distinct = _shared_counts(rows)
    # two stretches of T or more without repeated shingles share more than others have to
    open_ = np.tril(counts >= np.where(distinct[:, None] & distinct, -(-2 * percent * T // (100 + percent)), T * percent // 100), -1)
    if len(set(blocks)) > 1:
        open_ &= np.array(blocks)[:, None] != np.array(blocks)
    for i in np.flatnonzero(open_.any(axis=1)):
        own, at = rows[i], columns[i]
        candidates = np.flatnonzero(open_[i])

        def flags(chosen: np.ndarray, own: tuple = own, at: np.ndarray = at, plain: bool = distinct[i]) -> np.ndarray:
            """Which shingles of the row a passage shared with each of the chosen rows may hold."""
            place = places[np.ix_(chosen, at)]
            place[:, at < 0] = -1
            shared = place >= 0
            if plain:
                low, high, holds = _both_reach(place, own[2], percent)
                holds &= distinct[chosen]
                other = np.flatnonzero(~holds)
                if len(other):
                    low[other], high[other] = _reach(shared[other], own[2], percent)
                    high[other[~_dense(shared[other], own[2], percent)]] = 0
                inside = np.arange(len(at))
                shared &= (inside >= low[:, None]) & (inside < high[:, None])
            return shared

        # flags cost more than a comparison: of many candidates only those get them that may share more than the
        # best one that has them. What others share is at most the counts, later what lies beyond the verified
        candidates = candidates[np.argsort(-counts[i, candidates], kind="stable")]
        some = AHEAD if distinct[i] else len(candidates)
        held, rest = candidates[:some], candidates[some:]
        shared, bound = flags(held), counts[i, rest]
        sources: list[int] = []
        first, last = len(at), -1
        while True:
            # all passages hold the centre, so those verified are one stretch
            new = shared[:, :first].sum(axis=1) + shared[:, max(first, last + 1) :].sum(axis=1)
            most = int(new.max(initial=0))
            best = int(np.where(new == most, held, len(rows)).argmin()) if len(held) else 0
            if len(rest):
                open_yet = (bound > most) | ((bound == most) & (rest < held[best])) if most else bound > 0
                if open_yet.any():
                    more = np.flatnonzero(open_yet)[: max(AHEAD, len(held))]
                    held, shared = np.concatenate([held, rest[more]]), np.concatenate([shared, flags(rest[more])])
                    rest, bound = np.delete(rest, more), np.delete(bound, more)
                    continue
            if not most:
                break
            other = rows[held[best]]
            found = shared_passage(listed(i), own[2], listed(held[best]), other[2], percent)
            left = new > 0
            left[best] = False
            held, shared = held[left], shared[left]
            if found and (own[0] != other[0] or other[1] + found[3] + WORDS <= own[1] + found[0]):
                if other[0] not in sources:
                    sources.append(other[0])
                first, last = min(first, found[0]), max(last, found[1])
                if len(rest):
                    beyond = np.concatenate([at[:first], at[last + 1 :]])
                    bound = (places[np.ix_(rest, beyond[beyond >= 0])] >= 0).sum(axis=1)
                    rest, bound = rest[bound > 0], bound[bound > 0]
        if sources:
            out.append((own[0], sources, own[1] + first, own[1] + last + WORDS))
    return out


def _compared(keyed: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Word spans of passages near to one before them in their signature; see group_spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        blocks: list[int] = []
        group = None
        out: list[tuple] = []

        def spans() -> list[tuple]:
            if len(rows) < 2 or (group[1] != group[2] and len(set(blocks)) < 2):
                return []
            return group_spans(rows, blocks, percent)

        def table() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["key", "sources", "begin", "end"])

        for batch in batches:
            for sig, b1, b2, block, key, pos, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (sig, b1, b2) != group:
                    out += spans()
                    rows, blocks, group = [], [], (sig, b1, b2)
                c, left = pos >> 16, (pos >> 8) & 255
                rows.append((key, c - left, left, np.frombuffer(data, np.uint64)))
                blocks.append(block)
            if out:
                yield table()
                out.clear()
        out += spans()
        if out:
            yield table()

    dealt = _dealt(_slices(keyed, wanted), wanted.groupBy("sig").count()).sortWithinPartitions("sig", "b1", "b2", "key", "pos")
    dealt = dealt.select("sig", "b1", "b2", "block", "key", "pos", "shingles")
    return dealt.mapInArrow(run, "key long, sources array<long>, begin long, end long")


def passage_spans(keyed: DataFrame, hashes: int = HASHES, percent: int = PERCENT) -> DataFrame:
    """key, sources (keys of texts that hold passages of it too), begin, end (words, end excluded)."""
    windows = _windows(keyed.where(F.octet_length("text") >= 2 * MIN_WORDS - 1), hashes)
    by_sig = W.partitionBy("sig").orderBy("h", "key", "pos")
    by_window = W.partitionBy("sig", "h").orderBy("key", "pos")
    met = windows.select(
        "*", F.lag("sig").over(by_sig).alias("a"), F.lead("sig").over(by_sig).alias("b"), F.first(F.struct("key", "pos")).over(by_window).alias("one")
    )
    collapsed = F.col("source_pos").isNotNull()
    source = F.when(collapsed, F.struct(F.col("h").alias("key"), F.col("source_pos").alias("pos"))).otherwise(F.col("one"))
    met = met.where(collapsed | F.col("a").isNotNull() | F.col("b").isNotNull())
    met = stage(met.select("key", "sig", "pos", source.alias("one")), "passages-met")
    is_first = (F.col("key") == F.col("one.key")) & (F.col("pos") == F.col("one.pos"))
    firsts = met.where(is_first).select("key", "sig", "pos")
    several = stage(firsts.groupBy("sig").count().where("count > 1"), "passages-signatures")
    sharing_ = _sharing(keyed, firsts.join(several, "sig").select("key", "sig", "pos"), several, percent)
    wanted = stage(sharing_.dropDuplicates(["sig", "key", "pos"]), "passages-sharing")
    spans = _equal_spans(met.where(~is_first).select("key", "pos", F.col("one.key").alias("source"), F.col("one.pos").alias("source_pos")))
    return spans.unionByName(_compared(keyed, wanted, percent))


def merged_spans(spans: DataFrame) -> DataFrame:
    """key, begin, end, sources of spans that touch or overlap, put together within each key."""
    own = W.partitionBy("key").orderBy("begin", "end")
    reach = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.groupBy("key", "begin", "end").agg(F.array_distinct(F.flatten(F.collect_set("sources"))).alias("sources"))
    marked = spans.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("begin")).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    together = F.array_distinct(F.flatten(F.collect_set("sources"))).alias("sources")
    return marked.groupBy("key", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), together).drop("run")


def keyed_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def passages(docs: DataFrame, hashes: int = HASHES, percent: int = PERCENT) -> DataFrame:
    """One row per stretch of passages that repeat ones of other places: doc_id, source_doc_id, begin_word,
    end_word (excluded), n_words, source_doc_ids (texts that hold passages of it: the first holder of one that
    repeats word for word, the verified ones of others; source_doc_id is one of them)."""
    keyed = keyed_rows(docs)
    spans = stage(merged_spans(passage_spans(keyed, hashes, percent)), "passages-found")
    names = keyed.select("key", "doc_id").dropDuplicates(["key"])
    links = spans.select("key", "begin", "end", F.explode("sources").alias("source"))
    links = links.join(names.select(F.col("key").alias("source"), F.col("doc_id").alias("source_doc_id")), "source")
    sources = F.sort_array(F.collect_set("source_doc_id")).alias("source_doc_ids")
    linked = links.groupBy("key", "begin", "end").agg(F.min_by("source_doc_id", "source").alias("source_doc_id"), sources)
    named = linked.join(names, "key")
    words = (F.col("end") - F.col("begin")).alias("n_words")
    return named.select("doc_id", "source_doc_id", F.col("begin").alias("begin_word"), F.col("end").alias("end_word"), words, "source_doc_ids")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (sorted, disjoint) and the white space behind them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = starts[min(b, len(starts) - 1)]
    out.append(text[at:])
    left = b"".join(out)
    return left.rstrip() if spans and at == len(text) else left


def without_passages(docs: DataFrame, hashes: int = HASHES, percent: int = PERCENT) -> DataFrame:
    """docs with every repeated passage cut out of its text but one; texts of which no word is left
    go. n_chars, where it is a column, follows the text."""
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id"), F.col("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = merged_spans(passage_spans(rows.select("doc_id", "text", "key"), hashes, percent))
    own = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("own"))
    cut = rows.join(own, "key", "left")

    @F.pandas_udf("string")
    def shorter(text, own):
        import pandas as pd

        return pd.Series([cut_words(t.encode(), [(s["begin"], s["end"]) for s in o]).decode() if t is not None and o is not None else t for t, o in zip(text, own)])

    hit = F.col("own").isNotNull()
    changed = F.when(hit, shorter("text", "own")).otherwise(F.col("text"))
    kept = cut.withColumn("__new", changed).where(~hit | F.col("__new").rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col("__row")[c].alias(c) if c not in ("text", "n_chars") else None for c in docs.columns]
    new = {"text": F.col("__new").alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(hit, F.length("__new").cast(kind)).otherwise(F.col("__row")["n_chars"]).alias("n_chars")
    return kept.select(*[c if c is not None else new[n] for n, c in zip(docs.columns, columns)])


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
