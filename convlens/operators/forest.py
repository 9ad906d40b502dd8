"""Random forests with bagging by row, and all forests of a cross-validation from one deal of the rows.

Every tree is grown from all rows, whatever the size of the table. Features are binned once, at exact quantiles of
all rows. How often a row is in the bag of a tree is a Poisson number drawn from a hash of its key and the tree, so
neither partitions nor row order are part of the model. Spark deals the rows to trees, packed into blocks of bytes,
some trees at a time so that the shuffle stays a few times the table; the task of a tree keeps its rows in a file of
its own beyond ``HELD`` bytes, passes them once for each level, and holds one block of rows and the histograms of a
level. It grows the tree once on all rows and once without each fold, as the same rows with one fold masked.

Splits are searched over ``BINS`` values, ties go to the earlier feature tried and the lower value. Histograms are
whole numbers, so the order of the rows changes no tree. Missing values are larger than all others.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.columns import quoted
from convlens.operators.percentiles import bin_limits
from convlens.sources.staging import stage

BINS = 32
#: Trees that get their rows at a time, and copies of rows dealt at a time if that makes more of them. Neither changes a tree.
TREES_AT_ONCE = 24
ROWS_AT_ONCE = 8_000_000
#: Rows of a tree looked at together, rows packed together, and bytes held in memory before they go to a file.
BLOCK = 1 << 20
PACKED = 4096
HELD = 1 << 25
#: With so many nodes the rows of a block are put in their order, so that histograms stay in the processor's cache.
SORTED = 4096
#: Nodes whose splits are searched, and nodes of a model that come to the driver, together.
SEARCHED = 1024
FETCHED = 2_000_000
#: Cumulative probabilities of a Poisson number with mean 1; the rest of its tail is 1e-6.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)
NODES = "fit int, tree int, node int, feature int, cut int, left int, probability double, gain double"


@dataclass(frozen=True)
class ForestModel:
    """features and the edges of their bins; table: one row per node of each tree."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    table: DataFrame

    @cached_property
    def nodes(self) -> pd.DataFrame:
        return self.table.toPandas()

    def _fetched(self, *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
        """tree, node and the columns, in order of trees and nodes; some trees at a time."""
        found = self.table.agg(F.count(F.lit(1)), F.max("tree")).first()
        trees = (found[1] if found[1] is not None else -1) + 1
        step = max(1, trees * FETCHED // max(found[0], 1))
        for start in range(0, trees, step):
            some = self.table.where(F.col("tree").between(start, start + step - 1)).select("tree", "node", *columns).toArrow()
            tree, node, *rest = (c.to_numpy() for c in some.columns)
            order = np.lexsort((node, tree))
            yield tree[order], node[order], *(x[order] for x in rest)

    @property
    def arrays(self) -> tuple[np.ndarray, ...]:
        """(roots, feature, cut, left, probability) of all trees in one numbering, and the depth of
        each tree; a leaf leads to itself."""
        parts, before = [], 0
        for tree, _, feature, cut, left, probability in self._fetched("feature", "cut", "left", "probability"):
            size = np.unique(tree, return_counts=True)[1]
            roots = np.cumsum(size) - size
            leaf = feature < 0
            left = np.where(leaf, np.arange(len(tree)), left + np.repeat(roots, size))
            level = np.zeros(len(tree), np.int64)
            inner = roots[~leaf[roots]]
            while len(inner):
                below = np.concatenate([left[inner], left[inner] + 1])
                level[below] = np.tile(level[inner] + 1, 2)
                inner = below[~leaf[below]]
            depth = np.maximum.reduceat(level, roots) if len(roots) else level
            feature, cut = np.where(leaf, 0, feature).astype(np.int16), np.where(leaf, BINS, cut).astype(np.uint8)
            parts.append((roots + before, feature, cut, (left + before).astype(np.int32), probability, depth))
            before += len(tree)
        kinds = (np.int64, np.int16, np.uint8, np.int32, np.float64, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, k) for k in kinds)

    def importances(self) -> list[float]:
        """Impurity gained by each feature, as a share of each tree's, averaged over the trees."""
        share, grown = np.zeros(len(self.features)), 0
        for tree, _, feature, gain in self._fetched("feature", "gain"):
            inner = feature >= 0
            number = np.unique(tree[inner], return_inverse=True)[1]
            gained = np.bincount(number * len(share) + feature[inner], gain[inner], (number.max(initial=-1) + 1) * len(share))
            gained = gained.reshape(-1, len(share))
            share += (gained / gained.sum(axis=1, keepdims=True)).sum(axis=0)
            grown += len(gained)
        share /= max(grown, 1)
        return [float(x / (share.sum() or 1.0)) for x in share]

    def save(self, spark: SparkSession, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [(i, f, [float(x) for x in e]) for i, (f, e) in enumerate(zip(self.features, self.edges))]
        spark.createDataFrame(rows, "position int, feature string, edges array<double>").write.mode("overwrite").parquet(f"{path}/bins")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        bins = spark.read.parquet(f"{path}/bins").orderBy("position").collect()
        edges = tuple(np.array(r["edges"]) for r in bins)
        return ForestModel(tuple(r["feature"] for r in bins), edges, spark.read.parquet(f"{path}/nodes"))


def _unit(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def bin_edges(t: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Quantiles of each feature over all rows."""
    found = bin_limits(t, features, bins)
    return [np.array(found[f], np.float64) for f in features]


def _binned(batch: pa.RecordBatch, features: Sequence[str], edges: Sequence[np.ndarray]) -> np.ndarray:
    """rows x features, the bin of each value."""
    out = np.zeros((batch.num_rows, len(features)), np.uint8)
    for i, (f, e) in enumerate(zip(features, edges)):
        x = batch.column(batch.schema.get_field_index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, i] = np.where(np.isnan(x), len(e), np.searchsorted(e, x, side="left"))
    return out


class _Rows:
    """The rows of a tree (bins, kind, fold, how often), with the node each has reached, in files beyond ``HELD`` bytes."""

    def __init__(self, features: int, kinds: int = 2) -> None:
        self.width, self.number = features + 3, 0
        self.cells, self.places = (tempfile.SpooledTemporaryFile(HELD) for _ in range(2))
        self.totals = np.zeros((256, kinds), np.int64)  # by fold and kind

    def add(self, cells: bytes) -> None:
        self.cells.write(cells)
        c = np.frombuffer(cells, np.uint8).reshape(-1, self.width)
        self.number += len(c)
        cell = c[:, -2].astype(np.int64) * self.totals.shape[1] + c[:, -3]
        self.totals += np.bincount(cell, c[:, -1], self.totals.size).astype(np.int64).reshape(self.totals.shape)

    def histogram(self, split: tuple[np.ndarray, ...] | None, number: np.ndarray, tried: np.ndarray, kinds: int, skip: int) -> np.ndarray:
        """(feature tried, node, bin, kind): how often rows are in each cell. split: feature, cut and first child of each
        node of the level before (None at the root, where the rows of fold ``skip`` go), -1 where there is none;
        number: of each node of this level in ``tried``, -1 if it is not split."""
        out = np.zeros((tried.shape[1], len(tried) * BINS * kinds), np.int64)
        columns = np.ascontiguousarray(tried.T)
        for start in range(0, self.number, BLOCK):
            size = min(BLOCK, self.number - start)
            self.cells.seek(start * self.width)
            flat = np.frombuffer(self.cells.read(size * self.width), np.uint8)
            if split is None:
                at = np.where(flat[self.width - 2 :: self.width] == skip, -1, 0).astype(np.int32)
            else:
                self.places.seek(4 * start)
                at = np.frombuffer(self.places.read(4 * size), np.int32).copy()
                live = np.flatnonzero(at >= 0)
                feature, cut, child = (x.take(at[live]) for x in split)
                at[live] = np.where(child < 0, -1, child + (flat.take(live * self.width + feature) > cut))
            if len(tried) >= SORTED:
                order = np.argsort(at.astype(np.int16) if len(number) < 1 << 15 else at, kind="stable")
                flat, at = flat.reshape(-1, self.width).take(order, axis=0).ravel(), at[order]
                self.cells.seek(start * self.width)
                self.cells.write(flat.tobytes())
            self.places.seek(4 * start)
            self.places.write(at.tobytes())
            node = np.where(at >= 0, number.take(at, mode="clip"), -1)
            rows = np.flatnonzero(node >= 0)
            if not len(rows):
                continue
            node, first = node[rows], rows * self.width
            cell = node * (BINS * kinds) + flat.take(first + self.width - 3)
            often = flat.take(first + self.width - 1).astype(np.float64)
            for i, f in enumerate(columns):
                at_bin = flat.take(first + f.take(node)).astype(np.int64)
                out[i] += np.bincount(cell + at_bin * kinds, often, out.shape[1]).astype(np.int64)
        return out.reshape(len(columns), len(tried), BINS, kinds)


def _weighed(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return sum(counts[..., i] * w for i, w in enumerate(weight))


def _levels(rows: _Rows, skip: int, weight: np.ndarray, truth: np.ndarray, depth: int, min_leaf: int, tries: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """feature, cut, left, probability and gain of the nodes of a tree; see grow. weight, truth: of each kind of rows."""
    kinds, hits = len(weight), weight * truth
    counts = (np.delete(rows.totals, skip, 0) if skip >= 0 else rows.totals).sum(axis=0)[None]
    out, split, below = [], None, 1

    def impurity(w: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Gini impurity times weight."""
        return np.divide(2 * p * (w - p), w, out=np.zeros(np.broadcast(w, p).shape), where=w > 0)

    for level in range(depth + 1):
        k, size, total, positive = len(counts), counts.sum(axis=1), _weighed(counts, weight), _weighed(counts, hits)
        probability = np.divide(positive, total, out=np.zeros(k), where=total > 0)
        feature, cut, left, gained = np.full(k, -1), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k)
        out.append((feature, cut, left, probability, gained))
        # others cannot gain anything
        busy = np.flatnonzero((size >= max(1, 2 * min_leaf)) & (positive > 0) & (positive < total))
        if level == depth or not len(busy):
            break
        tried = rng.random((k, rows.width - 3)).argsort(1, kind="stable")[busy, :tries]
        number = np.full(k, -1)
        number[busy] = np.arange(len(busy))
        found = rows.histogram(split, number, tried, kinds, skip)
        before = np.zeros((k, kinds), np.int64)  # rows of the left child
        for start in range(0, len(busy), SEARCHED):
            own = busy[start : start + SEARCHED]
            c = found[:, start : start + SEARCHED].transpose(1, 0, 2, 3).cumsum(2)[:, :, :-1]
            n, w, p = c.sum(axis=3), _weighed(c, weight), _weighed(c, hits)
            all_n, all_w, all_p = (x[own, None, None] for x in (size, total, positive))
            gain = impurity(all_w, all_p) - impurity(w, p) - impurity(all_w - w, all_p - p)
            gain = np.where((n >= min_leaf) & (all_n - n >= min_leaf), gain, -1.0).reshape(len(own), -1)
            best = gain.argmax(1)
            each = np.arange(len(own))
            slot, place = np.divmod(best, BINS - 1)
            good = gain[each, best] > 1e-9 * np.maximum(total[own], 1e-300)
            feature[own] = np.where(good, tried[start + each, slot], -1)
            cut[own], gained[own] = np.where(good, place, 0), np.where(good, gain[each, best], 0.0)
            before[own] = c[each, slot, place]
        parents = np.flatnonzero(feature >= 0)
        if not len(parents):
            break
        child = np.full(k, -1)
        child[parents] = 2 * np.arange(len(parents))
        left[parents] = below + child[parents]
        below += 2 * len(parents)
        split = (feature, cut, child)
        counts = np.stack([before[parents], counts[parents] - before[parents]], axis=1).reshape(-1, kinds)
    return tuple(np.concatenate(x) for x in zip(*out))


def grow(bins: np.ndarray, y: np.ndarray, count: np.ndarray, weight: np.ndarray, depth: int, min_leaf: int, tries: int, rng: np.random.Generator) -> list[tuple]:
    """(feature, cut, left, probability, gain) of the nodes of one tree; the right child follows the left.

    All nodes of a level are split together: one histogram over (node, feature tried, bin).
    """
    (weights, truth), kind = np.unique(np.stack([weight, y]).astype(np.float64), axis=1, return_inverse=True)
    rows = _Rows(bins.shape[1], len(truth))
    rows.add(np.column_stack([bins, kind, np.full(len(y), 255), count]).astype(np.uint8).tobytes())
    return list(zip(*(x.tolist() for x in _levels(rows, -1, weights, truth, depth, min_leaf, tries, rng))))


_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _drawn(hashes: np.ndarray, tree: int) -> np.ndarray:
    """How often rows are in the bag of a tree; hashes: xxhash64 of their keys, which goes on here as Spark's does."""
    h = hashes + (_P5 + np.uint64(4))
    h ^= np.uint64(tree * int(_P1) & 0xFFFFFFFFFFFFFFFF)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    for shift, factor in ((33, _P2), (29, _P3)):
        h = (h ^ (h >> np.uint64(shift))) * factor
    h ^= h >> np.uint64(32)
    return np.searchsorted(POISSON, (h & np.uint64((1 << 53) - 1)) / float(1 << 53), side="right")


def fit_forests(
    t: DataFrame, features: Sequence[str], y: str, key: str, fold: str | None = None, folds: int = 0, trees: int = 200,
    depth: int = 15, min_leaf: int = 20, seed: int = 42, tree_rows: int | None = None, whole: bool = True,
) -> dict[int, ForestModel]:
    """Forests with balanced classes: -1 on all rows (with ``whole``), k on the rows outside fold k.

    A caller may ask for trees that see a slice of about ``tree_rows`` rows each; without it all see all.
    """
    label, part = quoted(y).cast("int"), quoted(fold).cast("int") if fold else F.lit(-1)
    sizes = {(r["y"], r["k"]): r["n"] for r in t.groupBy(label.alias("y"), part.alias("k")).agg(F.count("*").alias("n")).collect()}
    if not {c for c, _ in sizes} <= {0, 1} or folds > 255:
        raise ValueError("a forest needs labels 0 and 1 and at most 255 folds")
    rows = sum(sizes.values())
    edges = bin_edges(t, features)
    fits = [*([-1] if whole else []), *range(folds)]
    balance = {}  # weight of (fit, class): rows / (classes * rows of the class)
    for k in fits:
        own = {c: sum(n for (v, f), n in sizes.items() if v == c and f != k) for c in (0, 1)} if k >= 0 else {c: sum(n for (v, _), n in sizes.items() if v == c) for c in (0, 1)}
        balance[k] = [sum(own.values()) / (2 * own[c]) if own[c] else 0.0 for c in (0, 1)]
    names = [f"f{i}" for i in range(len(features))]
    tries = max(1, int(np.ceil(np.sqrt(len(features)))))
    share = min(1.0, (tree_rows or rows) / max(rows, 1))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PACKED):
                some = batch.slice(start, PACKED)
                hashes, places, label, masked = (some.column(i).to_numpy() for i in range(4))
                cells = np.column_stack([_binned(some, names, edges), label, masked]).astype(np.uint8)
                data = [[x.tobytes()] for x in (hashes, places, cells)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in data], names=["hashes", "places", "cells"])

    hashed = F.xxhash64(F.lit(f"bag-{seed}"), quoted(key))
    place = _unit(F.lit(f"slice-{seed}"), quoted(key)) * trees if share < 1.0 else F.lit(0.0)
    masked = F.when(part.between(0, folds - 1), part).otherwise(255)
    wide = t.select(hashed.alias("hash"), place.alias("place"), label.alias("y"), masked.alias("fold"), *[quoted(f).cast("double").alias(n) for f, n in zip(features, names)])
    cells = stage(wide.mapInArrow(packed, "hashes binary, places binary, cells binary"), "forest-rows")

    def some_trees(start: int, stop: int) -> DataFrame:
        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for hashes, places, data in zip(*(c.to_pylist() for c in batch.columns)):
                    h, at = np.frombuffer(hashes, np.uint64), np.frombuffer(places, np.float64)
                    c = np.frombuffer(data, np.uint8).reshape(len(h), -1)
                    out = []
                    for tree in range(start, stop):
                        often = _drawn(h, tree)
                        if share < 1.0:  # tree i takes the rows whose hash lies in [i / trees, i / trees + share), around the end
                            low = np.floor(at - share * trees) + 1
                            often[(tree - low) % trees > np.floor(at) - low] = 0
                        chosen = np.flatnonzero(often)
                        out.append(np.column_stack([c[chosen], often[chosen].astype(np.uint8)]).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(range(start, stop), pa.int32()), pa.array(out, pa.binary())], names=["tree", "cells"])

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, _Rows] = {}
            for batch in batches:
                for tree, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if tree not in held:
                        held[tree] = _Rows(len(names))
                    held[tree].add(data)
            for tree, own in held.items():
                for k in fits:
                    found = _levels(own, k, np.array(balance[k]), np.array([0, 1]), depth, min_leaf, tries, np.random.default_rng([seed, tree, k + 1]))
                    n = len(found[0])
                    columns = [np.full(n, k), np.full(n, tree), np.arange(n), *found]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kind)], schema=kind)

        kind = pa.schema([*[(c, pa.int32()) for c in ("fit", "tree", "node", "feature", "cut", "left")], ("probability", pa.float64()), ("gain", pa.float64())])
        rows_of_trees = cells.mapInArrow(dealt, "tree int, cells binary").repartitionById(stop - start, F.col("tree") - start)
        return stage(rows_of_trees.mapInArrow(grown, NODES), "forest-nodes")

    step = max(TREES_AT_ONCE, ROWS_AT_ONCE // max(rows, 1))
    nodes = reduce(DataFrame.unionByName, [some_trees(i, min(i + step, trees)) for i in range(0, trees, step)])
    return {k: ForestModel(tuple(features), tuple(edges), nodes.where(F.col("fit") == k)) for k in fits}


def _leaves(bins: np.ndarray, roots: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """rows x trees, the leaf of each row. Tree by tree, so that the nodes stay in the processor's cache."""
    flat, first = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    out = np.empty((len(bins), len(roots)), np.int64)
    for i, root in enumerate(roots):
        at = np.full(len(bins), root)
        for _ in range(depth[i]):
            here = flat.take(first + feature.take(at, mode="clip"), mode="clip")  # clip: no check of each index
            at = left.take(at, mode="clip") + (here > cut.take(at, mode="clip"))
        out[:, i] = at
    return out


def score_forest(model: ForestModel, t: DataFrame) -> DataFrame:
    """t with ``prediction`` and ``score``: the mean over the trees of the positive share in a row's leaf."""
    features, edges = model.features, model.edges
    roots, feature, cut, left, probability, depth = model.arrays
    names = [f"__f{i}" for i in range(len(features))]
    kept = list(t.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for start in range(0, batch.num_rows, 4096):
                bins = _binned(batch.slice(start, 4096), names, edges)
                scores[start : start + len(bins)] = probability[_leaves(bins, roots, feature, cut, left, depth)].mean(1)
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((scores > 0.5).astype(np.float64)), pa.array(scores)], names=[*kept, "prediction", "score"])

    schema = T.StructType([*t.schema.fields, T.StructField("prediction", T.DoubleType()), T.StructField("score", T.DoubleType())])
    wide = t.select(*[quoted(c) for c in kept], *[quoted(f).cast("double").alias(n) for f, n in zip(features, names)])
    return wide.mapInArrow(run, schema)
