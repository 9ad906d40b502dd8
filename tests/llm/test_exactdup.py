import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from convlens.llm import bytewindows, exactdup
from convlens.llm.suffixes import SuffixSort


def brute(rows, size):
    seen = Counter(t[i : i + size] for _, t in rows for i in range(len(t) - size + 1))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        runs = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("large", [1000, 2])  # 2: edges of shared passages go the way of very frequent anchors
def test_removal_matches_brute_force(docs, corpus, monkeypatch, large):
    monkeypatch.setattr(exactdup.repeated_spans, "__defaults__", (exactdup.SIZE, large))
    monkeypatch.setattr(bytewindows, "SEGMENT", 5000)
    got = exactdup.remove_repeats(docs).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == brute([(i, (t or "").encode()) for i, t, _ in corpus], 400)


def test_spans_of_a_planted_passage(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = noise(400)
    texts = [noise(300) + shared + noise(200), noise(50) + shared, noise(700), shared[:399] + "#" + noise(99)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in exactdup.remove_repeats(rows).collect()}
    assert got == {0: [(300, 700)], 1: [(50, 450)], 2: [], 3: []}


def test_suffix_sort_orders_and_finds_repeats():
    rng = np.random.default_rng(3)
    for letters, n, size in ((2, 400, 12), (3, 300, 5), (1, 60, 7)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8).tobytes()
        s = SuffixSort(data, size)
        at = np.arange(n - size + 1)
        klass = np.stack([rng.integers(0, 3, len(at)), rng.integers(0, 2, len(at))])
        names = [(*k, data[p : p + size]) for p, k in zip(at.tolist(), klass.T.tolist())]
        times = Counter(names)
        assert s.repeated(at, klass).tolist() == [times[x] > 1 for x in names]
        assert s._by_bytes(at, klass).tolist() == [times[x] > 1 for x in names]
        ranked = s.sort(at, np.zeros(len(at), np.int64), np.full(len(at), len(at)))
        strings = [data[p : p + size] for p in ranked]
        assert strings == sorted(strings) and sorted(ranked.tolist()) == at.tolist()


def test_false_equality_is_noticed(monkeypatch):
    s = SuffixSort(b"abcdefgh" * 4 + b"zyxwvuts" * 4, 8)
    monkeypatch.setattr(SuffixSort, "_same", lambda self, p, q, n: np.ones(len(p), bool))
    assert s.repeated(np.array([0, 40]), np.zeros((2, 2), np.int64)).tolist() == [False, False]


def test_windows_have_one_anchor_each():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (5000, 399, 400, 3000)] + [b"a" * 2000]
    for size, gram in ((400, 128), (50, 10)):
        covered = [set() for _ in texts]
        for c, _, _ in bytewindows.contexts(texts, size, gram):
            for i, a, b, at in zip(c.text, c.first, c.last, c.anchor):
                assert a <= at <= a + size - gram and b <= at
                assert not covered[i] & set(range(a, b + 1))
                covered[i] |= set(range(a, b + 1))
        assert [len(x) for x in covered] == [max(0, len(t) - size + 1) for t in texts]


def test_empty_and_odd_tables(no_docs, odd_docs, corpus):
    assert exactdup.remove_repeats(no_docs).count() == 0
    got = exactdup.remove_repeats(odd_docs).drop("spans").collect()
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    assert sorted(map(tuple, got), key=str) == brute(rows, 400)


@pytest.mark.parametrize("step", [32, 7])
def test_strings_of_frequent_anchors_are_settled_by_segments(spark, monkeypatch, step):
    """Many texts with one line in common, some of them with its surroundings: few strings become rows of their own."""
    monkeypatch.setattr(exactdup, "STEP", step)
    monkeypatch.setattr(exactdup.repeated_spans, "__defaults__", (exactdup.SIZE, 8))
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, before, behind = noise(200), noise(150), noise(150)
    rows = [(i, noise(300) + line + noise(300)) for i in range(90)]
    rows += [(100 + i, noise(200) + before[i:] + line + behind[: 150 - 2 * i] + noise(200)) for i in range(40)]
    rows += [(200 + i, noise(200) + before + line + behind + noise(200)) for i in range(20)]
    made = []
    monkeypatch.setattr(exactdup, "stage", lambda t, label, own=exactdup.stage: made.append((label, own(t, label))) or made[-1][1])
    got = exactdup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == brute([(i, t.encode()) for i, t in rows], 400)
    assert sum(r[2] > 0 for r in got) > 20
    edges = dict(made)["exactdup-edges"].where("large").agg({"n": "sum"}).first()[0]
    assert edges > 3000 and dict(made)["exactdup-strings"].count() < edges / 3
