"""Top k by inner product against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlens.llm import topk

SCHEMA = "vec_id long, vector array<float>, label int, uid string, shard string, beat string"


def brute(rows, every, k):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(usable):
        if i % every == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(usable) if n != at]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(spark, rows, every, k, **more):
    t = spark.createDataFrame([(i, v, 0, "u", "s", "b") for i, v in rows], SCHEMA)
    got = topk.search(t.repartition(4) if rows else t, F.col("vec_id") % every == 0, k, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(n, width, seed, fill=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.05) if rng.random() < fill else 0.0 for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("fill", [1.0, 0.1])
@pytest.mark.parametrize("more", [{}, {"shard_rows": 20, "query_rows": 7, "sample": 30, "pivots": 5}])
def test_equals_brute_force(spark, fill, more):
    rows = clustered(400, 16, 3, fill)
    assert found(spark, rows, 10, 5, **more) == brute(rows, 10, 5)


def test_hot_vector_and_ties(spark):
    rows = clustered(60, 8, 1) + [(100 + i, [0.5] * 8) for i in range(200)]
    assert found(spark, rows, 20, 5, shard_rows=16, sample=40) == brute(rows, 20, 5)


def test_odd_rows(spark):
    rows = clustered(12, 4, 2)
    rows += [(None, [1.0] * 4), (20, None), (30, [0.0] * 4), (40, []), (50, [0.1, 0.2]), (60, [float("nan"), 1.0, 1.0, 1.0]), (70, [1.0, None, 1.0, 1.0]), (80, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(10, [0.3] * 4), (10, [0.3] * 4), (90, [-0.4] * 4), (91, [float(2**18)] * 4)]
    assert found(spark, rows, 10, 5) == brute(rows, 10, 5)


def test_all_when_fewer(spark):
    rows = [(0, [0.1, -0.2]), (1, [0.3, 0.4])]
    assert found(spark, rows, 10, 5) == brute(rows, 10, 5)
    assert found(spark, rows[:1], 10, 5) == []
    assert found(spark, rows[1:], 10, 5) == []
    assert found(spark, [], 10, 5) == []


def test_only_vectors_of_no_length(spark):
    rows = [(0, []), (10, []), (11, [])]
    assert found(spark, rows, 10, 5) == brute(rows, 10, 5)


def test_component_too_large(spark):
    with pytest.raises(Exception, match="component"):
        found(spark, [(0, [float(2**25)]), (1, [1.0])], 10, 5)


def test_lists_stop_early():
    """A shard whose lists cannot reach the score to beat yields nothing, others only rows that reach it."""
    rng = np.random.default_rng(0)
    vectors = rng.integers(-60, 60, (500, 12))
    index, queries = topk.Postings(vectors), rng.integers(-60, 60, (20, 12))
    scores = queries @ vectors.T
    for beat in (-5000, 0, 4000, 9000, 10**7):
        got = {i: dict(zip(at.tolist(), s.tolist())) for i, at, s in index.search(queries, np.full(20, beat))}
        for i in range(20):
            assert got.get(i, {}) == {int(j): int(scores[i, j]) for j in np.flatnonzero(scores[i] >= beat)}
