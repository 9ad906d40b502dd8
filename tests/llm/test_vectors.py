import numpy as np
import pytest
from pyspark.sql import functions as F

from convlens.llm import vectors


def brute(rows, k):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in rows if j != i)
            out[i] = near[:k]
    return out


def run(spark, rows, k=10, **how):
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    got = {}
    for r in vectors.search(df, F.col("vec_id") % 100 == 0, k, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return got


def test_recall_on_given_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, 10)
    got = run(spark, rows, shard_rows=300, query_rows=7)
    assert set(got) == set(want)
    found = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    assert all(len(v) == 10 and v == sorted(v) for v in got.values())
    exact = {(q, j): d for q in want for d, j in want[q]}
    assert all(d == pytest.approx(exact[q, j], abs=1e-12) for q in got for d, j in got[q] if (q, j) in exact)


def test_recall_on_a_larger_random_table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, q = run(spark, rows), np.arange(0, 12_000, 100)
    d = ((x[q][:, None].astype(np.float64) - x[None].astype(np.float64)) ** 2).sum(-1)
    d[np.arange(len(q)), q] = np.inf
    want = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len({j for _, j in got[i]} & set(w.tolist())) / 10 for i, w in zip(q.tolist(), want)]) >= 0.9


def test_ties_odd_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (5, None), (200, [0.0, 0.0])]
    rows += [(300, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 2.0]), (400, [None, None]), (500, [])]
    got = run(spark, rows)
    assert {q: v for q, v in got.items()} == brute([r for r in rows if r[1] != []], 10)
    assert [j for _, j in run(spark, rows, k=2)[0]] == [1, 2]
    assert run(spark, [(100, [1.0, 2.0])]) == {} and run(spark, rows[6:8]) == {}
    assert spark.createDataFrame([], "vec_id long, vector array<float>").count() == 0


def test_footrule_matches_its_definition():
    rng = np.random.default_rng(2)
    order = np.array([rng.permutation(20)[:6] for _ in range(50)], np.int32)
    files = vectors.InvertedFiles(order, 20)
    for q in range(10):
        place = lambda o: {p: i for i, p in enumerate(o.tolist())}
        a = place(order[q])
        want = [sum(abs(a.get(p, 6) - b.get(p, 6)) for p in {*a, *b}) for b in map(place, order)]
        assert files.footrule(order[q]).tolist() == want


def test_many_copies_of_a_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(i, [float(i % 7), 1.0, 0.5]) for i in range(3000, 4000)]
    got = run(spark, rows, shard_rows=256)
    assert len(got) == 40
    assert all([j for _, j in got[q]] == [j for j in range(12) if j != q][:10] for q in range(0, 3000, 100))
