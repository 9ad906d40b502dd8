import re

import numpy as np
import pytest
from conftest_tools import components_of
from pyspark.sql import functions as F

from convlens.llm import jaccard
from convlens.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute(rows, k, percent):
    s = sets(rows, k)
    links = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    root = components_of(s, links)
    return {i: (len(s[i]), root[i]) for i in s}


@pytest.mark.parametrize("k, percent, short, block", [(4, 85, 8, 1024), (5, 80, 1, 3), (2, 50, 2, 2), (3, 20, 1, 1024)])
def test_components_match_brute_force(docs, corpus, monkeypatch, k, percent, short, block):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs, k, percent).collect()}
    assert got == brute([(i, t) for i, t, _ in corpus], k, percent)


def test_frequent_shingles_only_change_the_order(docs, corpus, monkeypatch):
    for frequent in (np.zeros(0, np.uint64), None):
        if frequent is None:
            frequent = np.unique(np.concatenate(jaccard.shingle_sets([t.encode() for _, t, _ in corpus[:9]], 4)))
        monkeypatch.setattr(jaccard, "frequent_shingles", lambda *a, f=frequent: f)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs).collect()}
        assert got == brute([(i, t) for i, t, _ in corpus], 4, 85)


def test_bitmaps_never_exceed_the_difference(spark):
    rng, rows = np.random.default_rng(1), []
    for n, m in ((5, 9), (300, 310), (300, 700), (700, 2000), (40, 5000)):
        pool = rng.integers(0, 2**63, n + m).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 2 : n // 2 + m])
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        rows += [(x.tolist(), y.tolist(), len(np.setxor1d(a, b))), (x.tolist(), x.tolist(), 0)]
        while len(y) > len(x):
            y = jaccard.folded(y)
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, d int")
    got = df.select(jaccard._differing_bits(F.col("x"), F.col("y")).alias("bits"), "d").collect()
    assert all(r["bits"] <= r["d"] for r in got) and any(r["bits"] > 100 for r in got)


def test_block_pairs_match_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(100, 400)], rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(40)]
    roots = [bytes([i % 7]) for i in range(40)]
    every = np.arange(40)
    sizes, bits = np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets]
    got = set(jaccard.close_pairs(sizes, roots, bits, every, every, 85, False))
    for i in range(40):
        for j in range(40):
            both = len(np.intersect1d(sets[i], sets[j]))
            if roots[i] != roots[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in got
    assert len(got) < 800 and not any(roots[i] == roots[j] for i, j in got)
    own = [bytes([i]) for i in range(40)]
    every_pair = jaccard.close_pairs(sizes, own, bits, every, every, 85, False)
    forest = jaccard.close_pairs(sizes, own, bits, every, every, 85, True)
    assert len(forest) < 40 and components_of(range(40), forest) == components_of(range(40), every_pair)


def test_one_of_each_component_stays(docs, corpus):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute([(i, t) for i, t, _ in corpus], 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (n, c) in want.items() if not n or c == i)


def test_empty_and_odd_tables(no_docs, odd_docs):
    assert jaccard.join_components(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0
    got = jaccard.join_components(odd_docs).collect()
    assert len(got) == 7 and all(r["component_id"] == 7 for r in got if r["n_shingles"])
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(odd_docs).collect()]
    texts = [r["text"] for r in odd_docs.where("doc_id = 7").collect()]
    assert sorted(kept, key=str) == sorted([(7, t) for t in {*texts}] + [(8, None), (8, None), (None, None)], key=str)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1400).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r["a"]: r["b"] for r in components(chain.union(star)).collect()}
    assert got == {**dict.fromkeys(range(1, 301), 0), **dict.fromkeys(range(1001, 1400), 1000)}
