"""Repairs against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from convlens.llm import conversations as cv

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}  # what the output ends with, and what may follow
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """All results for (turn, role, text) in order, by a search over suffixes."""
    kinds = faults(rows)

    @lru_cache(None)
    def best(i, end, inserted):
        found = []
        if i == len(rows) and end in ("", "a"):
            found.append((0, ""))
        if i < len(rows):
            steps = [("D", 2, end)]
            if kinds[i] not in ("blank", "duplicate"):
                more, initial = 5 * (kinds[i] == "truncated"), rows[i][1][:1]
                if (initial == "s" and end == "") or initial == NEXT[end]:
                    steps.append(("K", more, initial))
                steps.append(("R", 1 + more, NEXT[end]))
            for letter, cost, to in steps:
                rest = best(i + 1, to, 0)
                found.append((cost + rest[0], letter + rest[1]))
        if inserted < 3:
            rest = best(i, NEXT[end], inserted + 1)
            found.append((5 + rest[0], "I" + rest[1]))
        return min(found, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    out, end, left = [], "", iter(rows)
    for letter in audit:
        row = next(left) if letter != "I" else None
        if letter == "D":
            continue
        end = row[1][0] if letter == "K" else NEXT[end]
        out.append(f"{row[1] if letter == 'K' else NAMES[end]}:{row[2] if row else ''}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute(table, damage=True):
    by = {}
    for conv, turn, role, text in table:
        own = by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 19
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest())
    return {conv: plain(sorted(rows, key=order)) for conv, rows in by.items()}


def held(result):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = result.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string, kind string, n string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "n", "d") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd_rows():
    rng, rows = random.Random(5), []
    roles = ["user", "assistant", "system", "tool", None, "", "User", "user", "assistant", "é"]
    texts = [None, "", " \t", "Hi.", "Yes", "No?", "ok ...\n", "same", ".", "é!", " "]
    for conv in [None, 1, 2, 3, 4, 5, 6, 7, -8]:
        for _ in range({1: 700, 2: 1, None: 40}.get(conv, 30)):
            text = rng.choice([*texts, f"x{rng.randint(0, 60)}{rng.choice(['.', '', ' !'])}"])
            rows.append((conv, rng.choice([None, *range(600 if conv == 1 else 20)]), rng.choice(roles), text))
    rows += [(11, None, "user", "a."), (11, None, None, None), (12, 5, "user", "Only a question?")]
    rows += [(13, 3, "user", "again and again.")] * 40  # one row many times
    rows += [(14, i, "user" if i % 2 == 0 else "assistant", ("word " * 40000 if i == 4 else f"turn {i}") + ".") for i in range(8)]
    return rows


@pytest.mark.parametrize("damage", [True, False])
@pytest.mark.parametrize("length", [3, 256])
def test_equals_search(spark, odd_rows, monkeypatch, damage, length):
    monkeypatch.setattr(cv, "LEAST_BLOCK", length)
    monkeypatch.setattr(cv, "isqrt", lambda n: 2 if length == 3 else 255)
    t = table(spark, odd_rows)
    got = held(cv.repaired(t.select("conv_id"), cv.damaged(t) if damage else cv.as_found(t)))
    assert got == brute(odd_rows, damage)


def test_matrix_of_block_is_the_sweep():
    import numpy as np

    rng = random.Random(1)
    for n in (1, 2, 3, 7, 40):
        codes = np.array([rng.randrange(16) for _ in range(n)], np.uint8)
        forced = np.array([rng.randrange(3) for _ in range(n)])
        vector = cv.AT_END
        for c, f in zip(codes[::-1], forced[::-1]):
            vector = cv.before(int(c), int(f), vector)
        m = cv.between(codes, forced)
        assert vector == (m + np.array(cv.AT_END)[None, :]).min(1).tolist()


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    t = table(spark, [(conv, 0, "user", "gone.")])
    assert held(cv.repaired(t.select("conv_id"), cv.damaged(t))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert cv.repaired(t.select("conv_id"), cv.damaged(t)).collect() == []


def test_query(spark, small_dir):
    got = held(cv.op11_repair_conversations(spark, small_dir))
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(rows)
