"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order of distance. The pivots' inverted files hold,
for every pivot, the vectors that have it among their nearest and at which place. A query walks the
files of its own nearest pivots and adds up the footrule distance between its order and theirs
(a pivot missing from an order counts as standing at its end). Vectors within a footrule radius are
ranked again by their exact distance. The radius is no cap on candidates: it is set on a sample so
that it holds ``TARGET`` of the true neighbours there, which lie farther away than those in the whole
table, and a query that finds fewer than k candidates within it is compared with all vectors.

The index is cut by vectors into shards of about ``SHARD_ROWS`` rows, each with its own inverted
files; blocks of ``QUERY_ROWS`` queries meet every shard, and each pair of a block and a shard is one
bounded group. Only k rows per query and shard move on. Pivots (at most ``PIVOTS``) and the sample
that sets the radius are bounded; every row is indexed.

Recall is measured against brute force in tests/llm.

Defined results: vectors that are null, zero, of another dimension than most of the sample, or hold a
null or non-finite component take no part, neither as query nor as candidate; rows that share a
vec_id are separate candidates, but none of them is a candidate of a query with that id, equal rows
ask once and different rows of one id ask separately; a null vec_id takes no part; ties go to the smaller vec_id; with fewer candidates than k all are returned;
an empty table gives no rows; only vec_id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIVOTS = 256
PLACES = 64
SAMPLE = 4096
SHARD_ROWS = 4096
QUERY_ROWS = 1024
TARGET = 0.98


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def spread_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of the sample that lie far from one another: each next pivot is the farthest from those chosen."""
    chosen, away = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if away.max() <= 0:
            break
        chosen.append(int(away.argmax()))
    return sample[chosen]


def orders(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest ``places`` pivots of each vector, nearest first, ties to the earlier pivot."""
    d = (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :places].astype(np.int32)


class InvertedFiles:
    """For each pivot the rows that hold it and the place it has in their order."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.rows, self.places = len(order), order.shape[1]
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.start = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.row, self.place = by_pivot // self.places, (by_pivot % self.places).astype(np.int32)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of one order to every row; a missing pivot stands at place ``places``."""
        m = self.places
        # rows that share no pivot: each side pays for all of its own pivots
        total = np.full(self.rows, m * (m + 1), np.int32)
        for place, pivot in enumerate(order):
            own = slice(self.start[pivot], self.start[pivot + 1])
            there = self.place[own]
            total[self.row[own]] += np.abs(there - place) - (m - there) - (m - place)
        return total


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(1))


def nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest, ties to the smaller id."""
    if len(distance) > k:
        limit = np.partition(distance, k - 1)[k - 1]
        own = np.flatnonzero(distance <= limit)
    else:
        own = np.arange(len(distance))
    return own[np.lexsort((ids[own], distance[own]))][:k]


def fit(vectors: DataFrame, k: int, pivots: int = PIVOTS, places: int = PLACES, sample: int = SAMPLE, target: float = TARGET) -> tuple[np.ndarray, int] | None:
    """(pivots, footrule radius) from a bounded sample of the rows of (vec_id, vector)."""
    rows = vectors.orderBy(F.xxhash64(F.lit("pivots"), "vec_id"), "vec_id").limit(sample).collect()
    if not rows:
        return None
    sizes = [len(r["vector"]) for r in rows]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    points = np.array([r["vector"] for r in rows if len(r["vector"]) == size], np.float64)
    chosen = spread_pivots(points, pivots)
    places = min(places, len(chosen))
    order = orders(points, chosen, places)
    files = InvertedFiles(order, len(chosen))
    needed = []
    for q in range(0, len(points), max(1, len(points) // 512)):
        d = exact(points[q], points)
        d[q] = np.inf
        own = np.argsort(d, kind="stable")[: min(k, len(points) - 1)]
        needed.append(files.footrule(order[q])[own])
    found = np.concatenate(needed) if needed else np.zeros(0)
    radius = int(np.quantile(found, target)) if len(found) else places * (places + 1)
    return chosen, radius


def search(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """vectors: vec_id, vector. The k nearest of each query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    model = fit(vectors, k)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots, radius = model
    vectors = vectors.where(F.size("vector") == pivots.shape[1])
    queries = vectors.where(is_query).distinct().withColumn("ask", F.xxhash64("vector"))
    n, n_queries = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_rows))
    # rows spread by a hash of id and vector: many rows of one id or of one vector do not meet in one shard
    base = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
    base = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("ask", "vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    places = min(PLACES, len(pivots))

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(own) and len(asked):
            points, ids = np.stack(own["vector"].to_numpy()).astype(np.float64), own["vec_id"].to_numpy()
            wanted = np.stack(asked["vector"].to_numpy()).astype(np.float64)
            files = InvertedFiles(orders(points, pivots, places), len(pivots))
            rows = zip(wanted, asked["vec_id"], asked["ask"], orders(wanted, pivots, places))
            for q, name, ask, order in rows:
                others = ids != name
                close = (files.footrule(order) <= radius) & others
                if close.sum() < k:  # too few here: the whole shard is compared
                    close = others
                at = np.flatnonzero(close)
                d = exact(q, points[at])
                out += [(name, ask, ids[at[i]], d[i]) for i in nearest(d, ids[at], k)]
        return pd.DataFrame(out, columns=["query_id", "ask", "vec_id", "score"])

    found = base.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    found = found.applyInPandas(run, "query_id long, ask long, vec_id long, score double")
    order = W.partitionBy("query_id", "ask").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_permutation_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return search(rows, F.col("vec_id") % 100 == 0, 10)
