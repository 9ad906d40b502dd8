"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut into chunks where a rolling hash of the last 16 bytes ends in zeros, so texts that
share a passage share its chunks whatever stands before it. A chunk is encoded once and its ids are
reused wherever the chunk occurs again among the texts a worker sees (a cache of bounded size).
Encoding a chunk on its own can differ from encoding the whole text near its two ends. A join is
therefore re-encoded from the last sure boundary of the chunk before it to the first sure boundary
of a chunk after it, over as many chunks as it takes, so the ids agree exactly with those of the
whole text. A sure boundary is a space or line feed after a visible ASCII character: no piece that
the pre-tokenizer forms, and no added token, reaches across it. A text without one is a single piece.

Texts are not shuffled: sharing chunks over the whole cluster would move every text twice, which
costs more than encoding it. A lost executor costs the encoding of its partitions.

Defined results: a null text counts as empty and gives no ids; an empty text too; the length of a
text is not bounded (its pieces are encoded one by one); a null id is passed through; repeated rows
give repeated rows; an empty table gives none; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
MEAN_CHUNK_BITS = 10  # chunks of about 1 KB
CHUNK_CACHE = 24 << 20  # bytes in each worker
WORD_CACHE = 150_000  # pieces in each of two generations
TOGETHER = 8192  # new pieces given to the tokenizer at a time: what it returns for a piece is far larger than its ids
SEGMENT = 4 << 20  # bytes hashed at a time


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file as text; it travels to the tasks, so only the driver needs the path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as file:
        return file.read()


def _gear() -> np.ndarray:
    """One fixed pseudo-random 32-bit number for each byte value (multiplicative hashing)."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def cut_points(data: np.ndarray, bits: int = MEAN_CHUNK_BITS) -> np.ndarray:
    """Positions behind which a chunk ends: the rolling hash of 16 bytes has ``bits`` leading zeros."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):  # hash of 2, 4, 8, 16 bytes from two halves
        h[step:] += h[:-step] << np.uint32(step)
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1


def sure_points(data: np.ndarray) -> np.ndarray:
    before, here = data[:-1], data[1:]
    return np.flatnonzero(((here == 0x20) | (here == 0x0A)) & (before > 0x20) & (before < 0x7F)) + 1


def _by_segment(find, data: np.ndarray) -> np.ndarray:
    """find() over a long text in segments that overlap by the 16 bytes it looks back."""
    if len(data) <= SEGMENT:
        return find(data) if len(data) > 16 else np.empty(0, np.int64)
    found = []
    for start in range(0, len(data), SEGMENT):
        low = max(0, start - 16)
        at = find(data[low : start + SEGMENT]) + low
        found.append(at[at > start] if start else at)
    return np.concatenate(found)


def pieces(data: bytes, bits: int = MEAN_CHUNK_BITS) -> list[int]:
    """Bounds of the pieces of a text: chunk interiors and repaired joins in turn."""
    raw = np.frombuffer(data, np.uint8)
    sure = _by_segment(sure_points, raw)
    cuts = _by_segment(lambda x: cut_points(x, bits), raw)
    if not len(sure) or not len(cuts):
        return [0, len(data)]
    # the join at a cut reaches from the sure boundary at or before it to the next one after it
    at = np.searchsorted(sure, cuts, side="right")
    left = np.where(at > 0, sure[np.maximum(at - 1, 0)], 0)
    right = np.where(at < len(sure), sure[np.minimum(at, len(sure) - 1)], len(data))
    right = np.where(left == cuts, cuts, right)  # a cut on a sure boundary needs no repair
    return np.unique(np.concatenate([[0], left, right, [len(data)]])).tolist()


_BETWEEN = re.compile(rb"(?<=[!-~])(?=[ \n])")  # the sure boundaries


class ChunkEncoder:
    """Encodes texts chunk by chunk; chunks and pieces seen before are not encoded again."""

    def __init__(self, tokenizer: str, chunk_cache: int = CHUNK_CACHE, word_cache: int = WORD_CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk_cache, self.held, self.word_cache = chunk_cache, 0, word_cache
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}
        # ids of a piece, and the decoded text of the few that do not decode to themselves
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.altered: dict[bytes, bytes] = {}

    def _encode_pieces(self, new: list[bytes]) -> None:
        for start in range(0, len(new), TOGETHER):
            part = new[start : start + TOGETHER]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in part], add_special_tokens=False)]
            back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            for raw, own, text in zip(part, ids, back):
                self.words[raw] = struct.pack(f"<{len(own)}I", *own)
                if (decoded := text.encode("utf-8")) != raw:
                    self.altered[raw] = decoded

    def _learn(self, new: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        if len(self.words) > self.word_cache:
            self.words, self.older = {}, self.words
            self.altered = {x: y for x, y in self.altered.items() if x in self.older}
        split = [_BETWEEN.split(x) for x in new]
        unknown = []
        for word in {w for own in split for w in own}:
            if word not in self.words:
                known = self.older.get(word)
                if known is None:
                    unknown.append(word)
                else:
                    self.words[word] = known
        if unknown:
            self._encode_pieces(unknown)
        made, words, altered = {}, self.words, self.altered
        for raw, own in zip(new, split):
            decoded = b"".join([altered.get(w, w) for w in own]) if altered else raw
            made[raw] = b"".join([words[w] for w in own]), raw if decoded == raw else decoded
        return made

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        cut = []
        for data in texts:
            bounds = pieces(data)
            cut.append([data[a:b] for a, b in zip(bounds, bounds[1:])])
        new = list(dict.fromkeys(x for own in cut for x in own if x not in self.chunks))
        made = self._learn(new) if new else {}
        for own in cut:
            parts = [self.chunks.get(x) or made[x] for x in own]
            yield b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        for raw, value in made.items():
            self.held += len(raw) + len(value[0]) + 250
            self.chunks[raw] = value
        while self.held > self.chunk_cache:
            oldest = next(iter(self.chunks))
            self.held -= len(oldest) + len(self.chunks.pop(oldest)[0]) + 250


_ENCODERS: dict[str, ChunkEncoder] = {}  # of this worker, which serves many tasks


def encoder_of(spec: str) -> ChunkEncoder:
    return _ENCODERS.get(spec) or _ENCODERS.setdefault(spec, ChunkEncoder(spec))


def groups_of(sizes: Iterable[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive rows of about ``limit`` bytes together."""
    first, number, held = 0, 0, 0
    for size in sizes:
        number += 1
        held += size
        if held >= limit:
            yield first, number
            first, number, held = first + number, 0, 0
    if number:
        yield first, number


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>)."""
    spec = tokenizer_json(tokenizer)
    kind = docs.schema[ident].dataType
    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
            for first, number in groups_of(sizes.to_pylist()):
                # the texts of a group alone become Python objects, not those of the whole batch
                texts = [x or b"" for x in batch.column(1).slice(first, number).cast(pa.binary()).to_pylist()]
                count, ids_sha, text_sha, all_ids = [], [], [], []
                for ids, decoded in encoder.encode(texts):
                    count.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
                out = [batch.column(0).slice(first, number), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out, names = [*out, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    narrow = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", ident: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """id and text of rows that hold ids; null ids give an empty text."""
    spec = tokenizer_json(tokenizer)
    kind = rows.schema[ident].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoder_of(spec).tokenizer.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    narrow = rows.select(F.col(ident).alias("doc_id"), F.col(ids).alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {kind.simpleString()}, text string")


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
