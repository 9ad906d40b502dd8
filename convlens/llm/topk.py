"""Exact top-k search by inner product with MaxScore.

Vectors become integers, ``floor(256 * x)``; a dimension is a term, and its posting list holds the rows
of a shard that are not 0 there, with the least and the largest value as bounds. For one query a list
can add at most ``max(0, q * least, q * largest)`` to a score. Lists are ordered by that bound; those
whose bounds together stay below the score to beat are non-essential: a row that stands in none of the
others cannot win. Essential lists are traversed and added up, then the others are probed, largest bound
first, only for rows that can still reach the score to beat. Each shard gives its best k, which are merged.

Three things make the bounds sharp. Rows are dealt into shards by their nearest pivot, so that a
shard's bounds are narrow; a query starts with the k-th best score among a bounded sample of rows, which
is never above its final k-th score; and a query goes only to shards whose bounds can beat that. All
three only save work: the result is exact for any pivots and any sample.

A shard holds at most about ``shard_rows`` rows and meets blocks of at most about ``QUERY_ROWS`` queries,
so a task holds two bounded groups, however many rows are near one pivot. Pivots (``PIVOTS``), their
bounds and the sample (``SAMPLE`` rows) are the only things that all tasks receive.

Defined results: a vector that is null or holds a null or non-finite component takes no part; zero and
empty vectors do. Components that a shorter vector lacks count as 0. A null vec_id takes no part. Every
row whose id asks is a query of its own and has all rows but itself as candidates, also other rows of
the same id; so an id that comes twice has each rank twice. Ties go to the smaller vec_id. With fewer
candidates than k all are returned, an empty table gives no rows. Only vec_id and the vector are read.
A component beyond 2 ** 27 in size raises an error, as scores would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convlens.llm.vectors import spread_pivots
from convlens.sources.staging import stage

PIVOTS = 64
SAMPLE = 4096
LEAST_SHARD, SHARD_ROWS = 1024, 32_768
SHARDS = 64  # wanted, between these two sizes
QUERY_ROWS = 8192
HELD = 1 << 22  # scores of queries x rows in memory at once
LIMIT = 1 << 27
NOTHING = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, in double precision."""
    cell = lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int")
    large = F.exists(vector, lambda x: F.abs(x.cast("double")) * scale > float(LIMIT))
    return F.when(large, F.raise_error(F.lit(f"a component beyond {LIMIT}")).cast("array<int>")).otherwise(F.transform(vector, cell))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """One row a vector, missing components 0."""
    if len(vectors) and all(len(v) == width for v in vectors):
        return np.concatenate(list(vectors)).astype(np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


class Postings:
    """The inverted lists of one shard. Lists that hold much of the shard's rows are kept as columns,
    so that several queries traverse them in one product; the others as rows and values."""

    def __init__(self, vectors: np.ndarray):
        self.rows, self.width = vectors.shape
        self.by_row = vectors
        held = (vectors != 0).sum(0)
        self.columns = np.flatnonzero(4 * held >= self.rows)
        self.column = np.ascontiguousarray(vectors[:, self.columns].T)
        self.lists = {int(t): (at := np.flatnonzero(vectors[:, t]), vectors[at, t]) for t in np.flatnonzero((held > 0) & (4 * held < self.rows))}
        self.least, self.largest = vectors.min(0, initial=LIMIT), vectors.max(0, initial=-LIMIT)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that each list can add to a score of each query."""
        return np.maximum(queries * self.least, queries * self.largest)

    def _essential(self, bounds: np.ndarray, beat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms of each query by bound, number of non-essential ones): the most whose bounds together
        stay below the score to beat."""
        order = np.argsort(bounds, axis=1, kind="stable")
        below = np.cumsum(np.take_along_axis(bounds, order, 1), 1) < beat[:, None]
        return order, np.where(below.any(1), self.width - np.argmax(below[:, ::-1], 1), 0)

    def _traversed(self, queries: np.ndarray) -> np.ndarray:
        """Scores of all rows by the lists whose weight is not 0."""
        own = queries[:, self.columns]
        size = self.width * max(1, np.abs(own).max(initial=0)) * max(1, np.abs(self.column).max(initial=0))
        if size < 1 << 53:  # sums are exact in double precision
            score = (own.astype(np.float64) @ self.column.astype(np.float64)).astype(np.int64)
        else:
            score = own @ self.column
        for term, (rows, values) in self.lists.items():
            for i in np.flatnonzero(queries[:, term]):
                score[i, rows] += queries[i, term] * values
        return score

    def search(self, queries: np.ndarray, beat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores): every row whose score is ``beat`` or more, with its exact score."""
        if not self.rows:
            return
        if not self.width:
            yield from ((i, np.arange(self.rows), np.zeros(self.rows, np.int64)) for i in np.flatnonzero(beat <= 0))
            return
        together = max(1, HELD // self.rows)
        for start in range(0, len(queries), together):
            some, limit = queries[start : start + together], beat[start : start + together]
            bounds = self.bounds(some)
            order, split = self._essential(bounds, limit)
            weights = some.copy()
            for i, n in enumerate(split):
                weights[i, order[i, :n]] = 0
            whole = np.flatnonzero(split < self.width)  # the others can gain nothing here
            if not len(whole):
                continue
            scores = self._traversed(weights[whole])
            for i, score in zip(whole, scores):
                yield (start + int(i), *self._probed(some[i], bounds[i], order[i, : split[i]][::-1], score, limit[i]))

    def _probed(self, query: np.ndarray, bounds: np.ndarray, others: np.ndarray, score: np.ndarray, beat: int) -> tuple[np.ndarray, np.ndarray]:
        rest = int(bounds[others].sum())
        alive = np.flatnonzero(score >= beat - rest) if beat != NOTHING else np.arange(self.rows)
        score = score[alive]
        for term in others:
            if not len(alive):
                break
            rest -= int(bounds[term])
            score = score + query[term] * self.by_row[alive, term]
            still = score >= beat - rest
            alive, score = alive[still], score[still]
        return alive, score


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        own = np.flatnonzero(scores >= limit)
    else:
        own = np.arange(len(scores))
    return own[np.lexsort((ids[own], -scores[own]))][:k]


def near_pivot(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    away = (pivots.astype(np.float64) ** 2).sum(1)[None, :] - 2 * vectors.astype(np.float64) @ pivots.T.astype(np.float64)
    return away.argmin(1).astype(np.int32)


def _dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """uid, vec_id, vector and the pivot nearest to it."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("vector").to_numpy(zero_copy_only=False), width)
                yield batch.append_column("pivot", pa.array(near_pivot(vectors, pivots)))

    return rows.mapInArrow(run, "uid long, vec_id long, vector array<int>, pivot int")


def _boxes(rows: DataFrame, width: int, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, least, largest) of each pivot: combined in the tasks, at most PIVOTS x width rows are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = np.zeros(pivots, np.int64), np.full((pivots, width), LIMIT * 512), np.full((pivots, width), -LIMIT * 512)
        for batch in batches:
            vectors = matrix(batch.column("vector").to_numpy(zero_copy_only=False), width)
            pivot = batch.column("pivot").to_numpy()
            for p in np.unique(pivot):
                own = vectors[pivot == p]
                n[p] += len(own)
                low[p], high[p] = np.minimum(low[p], own.min(0)), np.maximum(high[p], own.max(0))
        p, d = np.nonzero(np.repeat(n[:, None] > 0, max(1, width), 1))
        out = [p, d, n[p], low[p, d] if width else n[p] * 0, high[p, d] if width else n[p] * 0]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["pivot", "term", "n", "low", "high"])

    part = rows.select("vector", "pivot").mapInArrow(run, "pivot long, term long, n long, low long, high long")
    found = part.groupBy("pivot", "term").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    n, low, high = np.zeros(pivots, np.int64), np.zeros((pivots, width), np.int64), np.zeros((pivots, width), np.int64)
    for r in found:
        n[r["pivot"]] = r["n"]
        if width:
            low[r["pivot"], r["term"]], high[r["pivot"], r["term"]] = r["low"], r["high"]
    return n, low, high


def _routed(queries: DataFrame, sample: tuple[np.ndarray, np.ndarray], boxes: tuple[np.ndarray, ...], salts: np.ndarray, k: int) -> DataFrame:
    """Each query once for every shard that can hold one of its k best, with the score to beat."""
    uids, points = sample
    n, low, high = boxes
    width, first = points.shape[1], np.cumsum(salts) - salts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Postings(points)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("vector").to_numpy(zero_copy_only=False), width)
            at, beats, shards = [], [], []
            names = batch.column("uid").to_numpy()
            for i, _, scores in index.search(vectors, np.full(len(vectors), NOTHING)):
                q, scores = vectors[i], scores[uids != names[i]]
                beat = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else NOTHING
                reach = np.maximum(q * low, q * high).sum(1)
                for p in np.flatnonzero((n > 0) & (reach >= beat)):
                    at += [i] * int(salts[p])
                    beats += [beat] * int(salts[p])
                    shards += range(int(first[p]), int(first[p] + salts[p]))
            out = batch.take(pa.array(at, pa.int64()))
            yield out.append_column("beat", pa.array(beats, pa.int64())).append_column("shard", pa.array(shards, pa.int64()))

    return queries.mapInArrow(run, "uid long, vec_id long, vector array<int>, beat long, shard long")


def search(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, shard_rows: int | None = None, query_rows: int = QUERY_ROWS, sample: int = SAMPLE, pivots: int = PIVOTS) -> DataFrame:
    """vectors: vec_id, vector. The k highest inner products of each query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", quantised(F.col("vector"), scale).alias("vector")), "topk-rows")
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.count_if(is_query).alias("asked")).first()
    if not total["n"] or not total["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = total["width"]
    some = rows.orderBy(F.xxhash64(F.lit("topk"), "vec_id", "uid"), "uid").limit(sample).collect()
    points = matrix([np.array(r["vector"], np.int64) for r in some], width)
    uids = np.array([r["uid"] for r in some])
    chosen = spread_pivots(points.astype(np.float64), pivots).astype(np.int64) if width else points[:1]

    rows = stage(_dealt(rows, chosen), "topk-dealt")
    boxes = _boxes(rows, width, len(chosen))
    size = shard_rows or min(SHARD_ROWS, max(LEAST_SHARD, -(-total["n"] // SHARDS)))
    salts = -(-boxes[0] // size)
    first = np.cumsum(salts) - salts
    # rows spread by a hash of the row: a pivot that is near to very many rows fills many shards
    many, start = F.array(*[F.lit(int(x)) for x in np.maximum(salts, 1)]), F.array(*[F.lit(int(x)) for x in first])
    at = F.col("pivot") + 1
    shard = F.element_at(start, at) + F.pmod(F.xxhash64("uid", F.lit("shard")), F.element_at(many, at))
    blocks = -(-total["asked"] // query_rows)
    base = rows.select("uid", "vec_id", "vector", shard.cast("long").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = _routed(rows.where(is_query).select("uid", "vec_id", "vector"), (uids, points), boxes, salts, k)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("uid", F.lit("block")), F.lit(blocks)).cast("int"))

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], [], []]
        if len(own) and len(asked):
            index = Postings(matrix(own["vector"].to_numpy(), width))
            ids, names = own["vec_id"].to_numpy(), own["uid"].to_numpy()
            uids, query_ids = asked["uid"].to_numpy(), asked["vec_id"].to_numpy()
            for i, at, scores in index.search(matrix(asked["vector"].to_numpy(), width), asked["beat"].to_numpy()):
                uid, name = uids[i], query_ids[i]
                others = names[at] != uid
                at, scores = at[others], scores[others]
                top = best(scores, ids[at], k)
                for column, values in zip(out, ([uid] * len(top), [name] * len(top), ids[at[top]].tolist(), scores[top].tolist())):
                    column += values
        return pd.DataFrame({c: np.array(x, np.int64) for c, x in zip(("uid", "query_id", "vec_id", "score"), out)})

    found = base.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    found = found.applyInPandas(run, "uid long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("uid").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return search(rows, F.col("vec_id") % 50 == 0, 5)
