"""Repair of conversation structure: the cheapest edits that make turns alternate.

A repaired conversation is empty or an optional system row followed by one or more pairs of user and
assistant. Every row is kept (0), given the role of user or assistant (1) or deleted (2; blank and
repeated rows must be), rows with empty text may be inserted anywhere (5), and a truncated row that is not
deleted costs 5 more. Of the cheapest sequences of edits the one with the ASCII-least initials is taken;
they fix the repaired text as well, as the grammar leaves one role for every place.

The state of a repair is what the output ends with, so what is left to pay from some row on is a
vector of four costs. Vectors are stored only at checkpoints and what lies between is recomputed while
walking forward, on two levels. A conversation is cut into blocks of about the square root of the longest
conversation; blocks are pieces of a range sort over (conversation, turn), so one conversation of any
length is spread over tasks. Each block of a conversation that has several gives its costs from each
state to each as a 4 x 4 matrix, made by its own task, and the vectors at the ends of the blocks follow
from these matrices alone. Then the blocks are walked in order, each with checkpoints at the square root of
its own length. The last step reads the rows of a conversation in order, as the hash of the repaired text is
sequential; it holds one block of row codes and no texts.

Defined results: nulls count as one space in the key of the damage, the role and the text; rows of
equal turn stand in order of role and SHA-256 of the text (equal rows together), turns that are null
first; the initial of a role is its first character as it stands; conversations without a row after
damage have zeros, no audit and the hash of the empty string; a null conv_id is one conversation;
equal texts are those of equal SHA-256; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.sources.staging import stage

SPACES = " \t\n\x0b\x0c\r"
LEAST_BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 50

# States: nothing yet, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
DONE = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

# A row as one byte: the initial of its role, whether it is truncated, whether it may stay.
INITIALS = "sua"
CUT, FREE = 4, 8


def kept_state(state: int, code: int) -> int | None:
    """Where keeping a row leads, if the grammar lets it."""
    initial = code & 3
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def relaxed(cost: list[int]) -> list[int]:
    """Costs when rows may be inserted first."""
    user, assistant = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
    return [min(cost[START], INSERT + user), min(cost[SYSTEM], INSERT + user), user, assistant]


AT_END = relaxed([0, FAR, FAR, 0])


def before(code: int, forced: int, after: list[int]) -> list[int]:
    """Costs before a row and the rows behind it that must go, from the costs after them."""
    cost = after
    if code & FREE:
        more = TRUNCATED if code & CUT else 0
        cost = []
        for state in range(4):
            least = min(DELETE + after[state], REROLE + more + after[NEXT[state]])
            stay = kept_state(state, code)
            cost.append(least if stay is None else min(least, KEEP + more + after[stay]))
    return relaxed([c + DELETE * forced for c in cost])


def _step(code: int) -> np.ndarray:
    """Costs from state to state over one row."""
    columns = [before(code, 0, [0 if s == to else FAR for s in range(4)]) for to in range(4)]
    return np.minimum(np.array(columns, np.int64).T, FAR)


STEPS = np.array([_step(code) for code in range(16)])


def between(codes: np.ndarray, forced: np.ndarray) -> np.ndarray:
    """Costs from each state before the block to each state after it, by pairwise (min, +) products."""
    m = STEPS[codes]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        a, b = m[: len(m) - len(odd) : 2], m[1 : len(m) - len(odd) + 1 : 2]
        m = np.concatenate([np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), FAR), odd])
    return m[0] + DELETE * int(forced.sum())


def walk(codes: bytes, forced: np.ndarray, end: list[int], state: int, last: bool) -> tuple[int, int, str, str]:
    """(cost from here on, state after, initials of all edits, initials without rows that must go).

    Only vectors at checkpoints are kept on the way back; each stretch between two is recomputed.
    """
    n, width = len(codes), isqrt(max(1, len(codes))) + 1
    checkpoints = {n: end}
    vector = end
    for i in range(n - 1, -1, -1):
        vector = before(codes[i], int(forced[i]), vector)
        if i % width == 0:
            checkpoints[i] = vector
    cost, audit, acts = vector[state], [], []
    for start in range(0, n, width):
        stop = min(start + width, n)
        vectors = [checkpoints[stop]]
        for i in range(stop - 1, start, -1):
            vectors.append(before(codes[i], int(forced[i]), vectors[-1]))
        vectors.append(checkpoints[start])
        for i in range(start, stop):
            code, after, here = codes[i], vectors[stop - 1 - i], vectors[stop - i]
            gone = int(forced[i])
            if code & FREE:
                more, left = TRUNCATED if code & CUT else 0, here[state] - DELETE * gone
                while left != DELETE + after[state]:
                    if here[state] == INSERT + here[NEXT[state]]:
                        letter, state, left = "I", NEXT[state], left - INSERT
                        audit.append(letter)
                        acts.append(letter)
                        continue
                    stay = kept_state(state, code)
                    if stay is not None and left == KEEP + more + after[stay]:
                        letter, state = "K", stay
                    else:
                        letter, state = "R", NEXT[state]
                    break
                else:
                    letter = "D"
                audit.append(letter)
                acts.append(letter)
            audit.append("D" * gone)
    while last and state not in DONE:
        state = NEXT[state]
        audit.append("I")
        acts.append("I")
    return cost, state, "".join(audit), "".join(acts)


def damaged(t: DataFrame) -> DataFrame:
    """Rows after damage, with n: how often they stand there."""
    blank = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = t.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).where("fate != 0")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def as_found(t: DataFrame) -> DataFrame:
    """Rows as they stand, for repairs without damage."""
    blank = F.lit(" ")
    return t.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.lit(1).cast("long").alias("n")
    )


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


ORDER = ["conv_id", "turn", "role", "digest"]
BLOCK = """conv_id long, turn long, role string, digest binary, part int, at int, codes binary, forced array<long>, blank long, duplicate long,
truncated long, illegal long, head string, tail string, low long, high long, turns long, matrix array<long>"""


class _Block:
    """Rows of one conversation in order, as many as fit."""

    def __init__(self, row: dict, at: int):
        self.first, self.at = row, at
        self.codes, self.forced = bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = ""
        self.low = self.high = None

    def add(self, row: dict) -> None:
        initial = row["role"][:1]
        free, n = bool(row["free"]), row["n"]
        code = INITIALS.index(initial) if initial and initial in INITIALS else 3
        self.codes.append(code | (CUT if row["truncated"] else 0) | (FREE if free else 0))
        self.forced.append(n - free)
        if row["blank"]:
            self.blank += n
        else:
            self.duplicate += n - free
            self.truncated += bool(row["truncated"]) and free
        initial = initial or " "
        self.illegal += n - 1 + (bool(self.tail) and (self.tail, initial) not in LEGAL)
        self.head, self.tail = self.head or initial, initial
        if row["turn"] is not None:
            self.turns += row["turn"] != self.high
            self.low, self.high = row["turn"] if self.low is None else self.low, row["turn"]

    def row(self, part: int, matrix: list[int] | None) -> dict:
        own = {c: self.first[c] for c in ORDER} | {"part": part, "matrix": matrix, "codes": bytes(self.codes)}
        return own | {c: getattr(self, c) for c in "at forced blank duplicate truncated illegal head tail low high turns".split()}


def _as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_BLOCK_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "turn")] + [("role", pa.string()), ("digest", pa.binary()), ("part", pa.int32()), ("at", pa.int32()), ("codes", pa.binary())]
    + [("forced", pa.list_(pa.int64()))] + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")] + [("head", pa.string()), ("tail", pa.string())]
    + [(c, pa.int64()) for c in ("low", "high", "turns")] + [("matrix", pa.list_(pa.int64()))]
)


def blocks(sequence: DataFrame, length: int) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, digest, n, blank, truncated, free) to blocks of at most
    ``length`` of them. A block that may not be its whole conversation has a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, out = TaskContext.get().partitionId(), None, True, []

        def closed(b: _Block, whole: bool) -> dict:
            matrix = None if whole else between(np.frombuffer(bytes(b.codes), np.uint8), np.array(b.forced)).ravel().tolist()
            return b.row(part, matrix)

        for batch in batches:
            for row in batch.to_pylist():
                if block is not None and row["conv_id"] != block.first["conv_id"]:
                    # neither the first conversation here nor cut: it has no rows elsewhere
                    out.append(closed(block, not first and block.at == 0))
                    block, first = None, False
                elif block is not None and len(block.codes) == length:
                    out.append(closed(block, False))
                    block = _Block(row, block.at + 1)
                if block is None:
                    block = _Block(row, 0)
                block.add(row)
                if len(out) >= 1024:
                    yield _as_batch(out, _BLOCK_SCHEMA)
                    out = []
        if block is not None:
            out.append(closed(block, False))
        if out:
            yield _as_batch(out, _BLOCK_SCHEMA)

    keys = [F.asc_nulls_first(c) for c in ORDER]
    return sequence.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, BLOCK)


def _ends(found: DataFrame) -> DataFrame:
    """For each block of a cut conversation (conv_id, part, at): the costs after it and whether it is the last.
    One conversation has about the square root of its rows of these."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["part", "at"], ignore_index=True)
        ends, vector = [], np.array(AT_END, np.int64)
        for matrix in own["matrix"][::-1]:
            ends.append(vector.tolist())
            vector = (np.asarray(matrix).reshape(4, 4) + vector[None, :]).min(1)
        return own[["conv_id", "part", "at"]].assign(end=ends[::-1], last=[i == len(own) - 1 for i in range(len(own))])

    cut = found.where("matrix is not null").select("conv_id", "part", "at", "matrix")
    return cut.groupBy("conv_id").applyInPandas(run, "conv_id long, part int, at int, end array<long>, last boolean")


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Conversation:
    """One conversation while its blocks and texts pass in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.counts = conv_id, dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.cost = None
        self.turns, self.tail, self.state, self.made = 0, "", START, START
        self.audit: list[str] = []
        self.acts: deque[str] = deque()
        self.hash, self.any = hashlib.sha256(), False

    def block(self, row: dict) -> None:
        for c in COUNTS:
            self.counts[c] += row[c]
        self.counts["illegal"] += bool(self.tail) and (self.tail, row["head"]) not in LEGAL
        self.tail = row["tail"]
        if row["low"] is not None:
            self.turns += row["turns"] - (row["low"] == self.high)
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        whole = row["end"] is None
        cost, self.state, audit, acts = walk(row["codes"], row["forced"], AT_END if whole else row["end"], self.state, whole or row["last"])
        self.cost = cost if self.cost is None else self.cost
        self.audit.append(audit)
        self.acts.extend(acts)

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserted(self) -> None:
        while self.acts and self.acts[0] == "I":
            self.acts.popleft()
            self.made = NEXT[self.made]
            self._write(NAMES[self.made], "")

    def text(self, row: dict) -> None:
        self._inserted()
        act = self.acts.popleft()
        if act == "K":
            self.made = kept_state(self.made, INITIALS.index(row["role"][0]))
            self._write(row["role"], row["text"])
        elif act == "R":
            self.made = NEXT[self.made]
            self._write(NAMES[self.made], row["text"])

    def result(self) -> dict:
        self._inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        own = {"conv_id": self.conv_id, "gaps": gaps, "cost": self.cost or 0}
        return own | self.counts | {"audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


_RESULT_SCHEMA = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", *COUNTS, "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, out = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if current is None or row["conv_id"] != current.conv_id:
                if current is not None:
                    out.append(current.result())
                current = _Conversation(row["conv_id"])
            if row["kind"] == 0:
                current.block(row)
            elif row["kind"] == 1:
                current.text(row)
        if len(out) >= 1024:
            yield _as_batch(out, _RESULT_SCHEMA)
            out = []
    if current is not None:
        out.append(current.result())
    if out:
        yield _as_batch(out, _RESULT_SCHEMA)


def repaired(originals: DataFrame, rows: DataFrame) -> DataFrame:
    """originals: conv_id of all conversations; rows: conv_id, turn, role, text, n. One row a conversation."""
    longest = rows.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bare = _bare(F.col("text"))
    facts = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "blank": bare == "", "truncated": ~F.right(bare, F.lit(1)).isin(".", "!", "?")})
    # the first of equal rows may stay; its text is moved once for all of them
    no_turn, least = F.max(F.col("turn").isNull()), F.min("turn")
    texts = facts.where("not blank").groupBy("conv_id", "role", "text").agg(F.when(~no_turn, least).alias("turn"))
    texts = stage(texts.withColumn("digest", F.unhex(F.sha2("text", 256))), "conversation-texts")
    flags = [F.max(c).alias(c) for c in ("blank", "truncated", "free")]
    all_rows = facts.select(*ORDER, "n", "blank", "truncated", F.lit(False).alias("free"))
    free = texts.select(*ORDER, F.lit(0).cast("long").alias("n"), F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("truncated"), F.lit(True).alias("free"))
    sequence = all_rows.unionByName(free).groupBy(*ORDER).agg(F.sum("n").alias("n"), *flags)
    found = stage(blocks(sequence, max(LEAST_BLOCK, isqrt(longest) + 1)), "conversation-blocks")

    ends = _ends(found).select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("at").alias("_at"), "end", "last")
    cut = found.where("matrix is not null").join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("at") == F.col("_at")))
    steps = cut.drop("_conv", "_part", "_at").unionByName(found.where("matrix is null"), allowMissingColumns=True).drop("part", "at", "matrix")
    steps = steps.withColumn("kind", F.lit(0))
    steps = steps.unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    steps = steps.unionByName(originals.select(F.col("conv_id").cast("long")).distinct().withColumn("kind", F.lit(2)), allowMissingColumns=True)
    order = [F.asc_nulls_first(c) for c in ORDER]
    return steps.repartition("conv_id").sortWithinPartitions(*order, "kind").mapInArrow(_written, RESULT)


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(t.select("conv_id"), damaged(t))
