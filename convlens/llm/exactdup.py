"""Removal of byte strings that start more than once, by hash-compared suffix sorting.

Strings of ``size`` bytes are the suffixes of the corpus cut at that length; a string repeats if a
neighbour in suffix order agrees with it over the whole length. Sorting the suffixes of a corpus in
one place is out of the question, so strings are first brought together by their anchors (see
``bytewindows``): equal strings have equal anchors at equal offsets. An anchor that occurs once ends
there. Contexts (runs of strings with one anchor) that are equal as a whole are settled by counting.
Only contexts that share an anchor and differ, the edges of shared passages, are fetched, and their
strings are suffix-sorted within anchor and offset.

An anchor with more than ``LARGE`` different contexts is not sorted in one task. Its contexts are cut into
segments of ``STEP`` offsets, settled as contexts are: strings of a segment are equal only where its core is, the
bytes that all of them hold, and segments equal as a whole are counted. Only the strings of segments that share a
core and differ become rows, counted by anchor, offset and a 128-bit hash, which splits an anchor as finely as it gets.

Defined results: a null text counts as empty; texts shorter than the string length lose nothing; a
string is removed wherever it starts twice, also within one text and across rows that repeat a whole
text; null and repeated ids are passed through (rows are told apart by id and text); a text of any
length is read whole; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm.bytewindows import contexts
from convlens.llm.suffixes import SuffixSort
from convlens.sources.staging import stage

SIZE = 400
LARGE = 64
STEP = 32
SORT_BYTES = 4 << 20  # bytes sorted together in a task


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _digests(parts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in parts]), "<i8").reshape(-1, 2)


def _contexts(keyed: DataFrame, size: int) -> DataFrame:
    """key, first, n (strings in the context), rel (offset of the anchor), ah (its hash), c1, c2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "first", "n", "rel", "ah", "c1", "c2"]
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                for c, data, shift in contexts(_texts(part.column(1)), size):
                    rel = c.anchor - c.first
                    low, high = (c.first + shift).tolist(), (c.last + shift + size).tolist()
                    ids = _digests([data[a:b] for a, b in zip(low, high)])
                    # the offset belongs to the context: equal bytes around another anchor are not equal
                    columns = [keys[start + c.text], c.first, c.last - c.first + 1, rel, c.hash.view(np.int64), ids[:, 0] + rel, ids[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=names)

    return keyed.select("key", "text").mapInArrow(run, "key long, first long, n long, rel long, ah long, c1 long, c2 long")


def _fetched(keyed: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted: key, ah, copies, first, n, rel. The same with the bytes of each context."""
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("ah", "copies", "large", "first", "n", "rel")).alias("own"))
    rows = keyed.join(per_text, "key").select("key", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "ah", "copies", "large", "first", "n", "rel", "bytes"]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out: list[tuple] = []
                for key, text, own in zip(part.column(0).to_pylist(), _texts(part.column(1)), part.column(2).to_pylist()):
                    out += [(key, w["ah"], w["copies"], w["large"], w["first"], w["n"], w["rel"], text[w["first"] : w["first"] + w["n"] + size - 1]) for w in own]
                columns = [pa.array(list(x), t) for x, t in zip(zip(*out), [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()])]
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "key long, ah long, copies long, large boolean, first long, n long, rel long, bytes binary")


def _runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags within a group."""
    on = np.flatnonzero(flags)
    if not len(on):
        return on, on
    new = np.concatenate([[True], (on[1:] != on[:-1] + 1) | (group[on[1:]] != group[on[:-1]])])
    first = np.flatnonzero(new)
    return on[first], on[np.append(first[1:], len(on)) - 1]


def _sorted_spans(found: DataFrame, size: int) -> DataFrame:
    """Spans of the contexts whose strings a neighbour in suffix order repeats; rows come sorted by ah."""

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        key, ah, copies, first, n, rel, data = zip(*rows)
        n_, first_ = np.array(n), np.array(first)
        base = np.cumsum([0, *map(len, data)])[:-1]
        sorter = SuffixSort(b"".join(data), size)
        owner = np.repeat(np.arange(len(rows)), n_)
        step = np.arange(n_.sum()) - np.repeat(np.cumsum(n_) - n_, n_)
        klass = np.stack([step - np.array(rel)[owner], np.array(ah)[owner]])
        flags = sorter.repeated(base[owner] + step, klass) & (np.array(copies)[owner] == 1)
        a, b = _runs(flags, owner)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(key, np.int64)[owner[a]]), pa.array(first_[owner[a]] + step[a]), pa.array(first_[owner[b]] + step[b] + size)],
            names=["key", "begin", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size_held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size_held > SORT_BYTES and row[1] != held[-1][1]:
                    yield resolve(held)
                    held, size_held = [], 0
                held.append(row)
                size_held += len(row[6])
        if held:
            yield resolve(held)

    columns = found.select("key", "ah", "copies", "first", "n", "rel", "bytes")
    dealt = columns.repartition("ah").sortWithinPartitions("ah")
    return dealt.mapInArrow(run, "key long, begin long, end long")


def _segments(found: DataFrame, size: int) -> DataFrame:
    """key, ah, copies, first, low, high (strings of the context, numbered from 0), seg, c1, c2 (core), u1, u2 (all bytes)."""
    step = max(1, min(STEP, size // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "ah", "copies", "first", "low", "high", "seg", "c1", "c2", "u1", "u2"]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows, cores, whole = [], [], []
                for key, ah, copies, first, n, rel, data in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    for seg in range(-rel // step, (n - 1 - rel) // step + 1):
                        begin = seg * step + rel
                        low, high = max(0, begin), min(n, begin + step) - 1
                        rows.append((key, ah, copies, first, low, high, seg, low - begin))
                        cores.append(data[begin + step - 1 : begin + size])
                        whole.append(data[low : high + size])
                columns = [np.array(c, np.int64) for c in zip(*rows)]
                c, u = _digests(cores), _digests(whole)
                # where the strings begin in the segment belongs to it: equal bytes from another offset on are not equal
                columns = [*columns[:7], c[:, 0], c[:, 1], u[:, 0] + columns[7], u[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=names)

    columns = found.select("key", "ah", "copies", "first", "n", "rel", "bytes")
    return columns.mapInArrow(run, "key long, ah long, copies long, first long, low long, high long, seg long, c1 long, c2 long, u1 long, u2 long")


def _strings(found: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted: key, first, copies, low, high. One row per string of these: key, ah, off, copies, at, w1, w2."""
    per_context = wanted.groupBy("key", "first").agg(F.collect_list(F.struct("copies", "low", "high")).alias("own"))
    rows = found.join(per_context, ["key", "first"]).select("key", "ah", "first", "rel", "bytes", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "ah", "off", "copies", "at", "w1", "w2"]
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out, strings = [], []
                for key, ah, first, rel, data, own in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns)):
                    for w in own:
                        for i in range(w["low"], w["high"] + 1):
                            out.append((key, ah, i - rel, w["copies"], first + i))
                            strings.append(data[i : i + size])
                ids = _digests(strings)
                columns = [*(np.array(c, np.int64) for c in zip(*out)), ids[:, 0], ids[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    return rows.mapInArrow(run, "key long, ah long, off long, copies long, at long, w1 long, w2 long")


def _counted_spans(found: DataFrame, size: int) -> DataFrame:
    """The same for anchors with very many contexts: segments counted, then one row per string of those left."""
    segments = stage(_segments(found, size), "exactdup-segments")
    core = ["ah", "seg", "c1", "c2"]
    name = [*core, "u1", "u2"]
    kinds = stage(segments.groupBy(*name).agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "first", "low", "high")).alias("one")), "exactdup-segment-kinds")
    repeated = kinds.where("copies > 1").select(*name)
    whole = segments.where("copies = 1").join(repeated, name).select("key", (F.col("first") + F.col("low")).alias("begin"), (F.col("first") + F.col("high") + size).alias("end"))
    open_ = kinds.groupBy(*core).agg(F.count(F.lit(1)).alias("d"), F.min("copies").alias("least")).where("d > 1 and least = 1").select(*core)
    wanted = kinds.join(open_, core).select("copies", "one.*")
    strings = stage(_strings(found, wanted, size), "exactdup-strings")
    name = ["ah", "off", "w1", "w2"]
    twice = strings.groupBy(*name).agg(F.sum("copies").alias("c")).where("c > 1").drop("c")
    single = strings.where("copies = 1").join(twice, name).select("key", F.col("at").alias("begin"), (F.col("at") + size).alias("end"))
    return whole.unionByName(single)


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that rows with the same id and text share."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def repeated_spans(keyed: DataFrame, size: int = SIZE, large: int = LARGE) -> DataFrame:
    """key, begin, end: byte ranges, not merged, that cover all strings which start more than once."""
    met = stage(_contexts(keyed.where(F.octet_length("text") >= size), size), "exactdup-contexts")
    # written first: a join of two plain shuffles can be split where one anchor holds many of the rows
    shared = stage(met.groupBy("ah").count().where("count > 1").select("ah"), "exactdup-anchors")
    met = stage(met.join(shared, "ah"), "exactdup-shared")
    name = ["ah", "c1", "c2"]
    kinds = stage(
        met.groupBy(*name).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "first", "n", "rel")).alias("one")), "exactdup-kinds"
    )
    repeated = stage(kinds.where("copies > 1").select(*name), "exactdup-repeated")
    whole = met.join(repeated, name).select("key", F.col("first").alias("begin"), (F.col("first") + F.col("n") + (size - 1)).alias("end"))
    open_ = kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("d"), F.min("copies").alias("least")).where("d > 1 and least = 1")
    wanted = kinds.join(open_, "ah").select("ah", "copies", (F.col("d") > large).alias("large"), "one.*")
    found = stage(_fetched(keyed, wanted, size), "exactdup-edges")
    spans = _sorted_spans(found.where("not large"), size).unionByName(_counted_spans(found.where("large"), size))
    return whole.unionByName(spans)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (merged byte ranges) of every row."""
    keyed = keyed_rows(docs)
    spans = repeated_spans(keyed, size).groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("own"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, runs, sha, ranges = [], [], [], [], []
            for text, own in zip(_texts(batch.column(1)), batch.column(2).to_pylist()):
                cut = _merged([(s["begin"], s["end"]) for s in own or []])
                digest, at = hashlib.sha256(), 0
                for a, b in cut:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                n.append(len(text)), removed.append(sum(b - a for a, b in cut)), runs.append(len(cut)), sha.append(digest.hexdigest())
                ranges.append([{"begin": a, "end": b} for a, b in cut])
            span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(ranges, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    rows = keyed.join(spans, "key", "left").select("doc_id", "text", "own")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>"
    return rows.mapInArrow(run, schema)


def op3_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("spans")
