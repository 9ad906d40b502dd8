"""Merkle manifest of a data set, and the versions that changed documents would make.

Every document is a leaf, the leaves of a source in order of id form a tree, and the roots of the sources
in order of source form another tree on top. While several nodes remain, each run of three consecutive
ones is hashed into one. H is SHA-256 in lowercase hex over its inputs one after the other, and digests
go in as their hex text.

The tree is cut into aligned blocks of ``3 ** HEIGHT`` nodes. A block is one bounded piece of work that
turns its nodes into one, and the roots of blocks are the nodes of the next tier, so a source of any size
takes a few rounds of joins and no task sees more than blocks. Leaves are numbered by a range sort and
the offsets of its partitions, without a window over a source.

A changed leaf makes a new version of the tree. It shares every node but its ancestors, and only these
are copied: inside the block of the leaf from the shared nodes of that block, and above it along the
path of the block, which the upper tiers hand down once for all versions of the block. So upper
versions are continued in as many tasks as there are blocks of leaves, and no version copies a tree.

Only digests move, never texts. Defined results: an empty table gives no rows; the text and columns
that are null count as ``-`` in the leaf; rows with equal ids (also null ones) are leaves in order
of their digests, null ids first; a row without id is never tampered with; only the columns doc_id,
source, lang, n_chars and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convlens.sources.staging import stage

FAN = 3
HEIGHT = 8
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def H(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(column: Column) -> Column:
    """``-`` for null, otherwise length in bytes, colon and value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[part(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def levels(nodes: list[str], height: int | None) -> list[list[str]]:
    """The levels of a block from its nodes to its root; with a height, so many steps up."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([H(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """(place in its run, the others of the run) of one node's ancestors, from the node up to below the root."""
    path = []
    for level in tree[:-1]:
        first = at - at % FAN
        path.append((at - first, level[first:at] + level[at + 1 : first + FAN]))
        at //= FAN
    return path


def copied(changed: str, path: list[tuple[int, list[str]]]) -> list[str]:
    """The new nodes of a version: the changed node and a copy of each ancestor."""
    nodes = [changed]
    for place, others in path:
        nodes.append(H([*others[:place], nodes[-1], *others[place:]]))
    return nodes


def packed(path: list[tuple[int, list[str]]]) -> str:
    """A path as text: for each level a digit for the place, one for the number of others, the others."""
    return "".join(f"{place}{len(others)}{''.join(others)}" for place, others in path)


def unpacked(path: str) -> list[tuple[int, list[str]]]:
    out, i = [], 0
    while i < len(path):
        place, n = int(path[i]), int(path[i + 1])
        out.append((place, [path[i + 2 + 64 * j : i + 66 + 64 * j] for j in range(n)]))
        i += 2 + 64 * n
    return out


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Adds pos (from 0, in order inside the group) and total (rows of the group); written to the shared folder.

    Rows are sorted by range over the whole table, so a group of any size spreads over many tasks; what
    is added is one offset for each group and partition.
    """
    keys = [F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order]]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the id counts rows inside a partition, and later partitions have larger ids
    ranged = stage(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), label)
    parts = ranged.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = W.partitionBy("_group")
    before = whole.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_group", "_of", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    joined = ranged.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "total")


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, from sorted batches."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in keys)
            if own != key and held:
                yield key, held
                held = []
            key = own
            held.append(row)
    if held:
        yield key, held


def _steps(total: int, height: int) -> int | None:
    """Steps from the nodes of a block to its root: all of them where the block is cut from more nodes."""
    return height if total > FAN**height else None


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Each block in one task, in order."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *order)


def roots_of_blocks(nodes: DataFrame, height: int) -> DataFrame:
    """grp, pos, total, digest to the same columns of the next tier."""

    size = FAN**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, block), rows in _blocks(batches, ["grp", "block"]):
            total = rows[0]["total"]
            root = levels([r["digest"] for r in rows], _steps(total, height))[-1][0]
            up = -(-total // size)
            yield pa.RecordBatch.from_pydict({"grp": pa.array([grp], pa.string()), "pos": pa.array([block], pa.int64()), "total": pa.array([up], pa.int64()), "digest": [root]})

    cut = nodes.select("grp", "pos", "total", "digest", F.floor(F.col("pos") / size).alias("block"))
    return _dealt(cut, "pos").mapInArrow(run, "grp string, pos long, total long, digest string")


def tiers(nodes: DataFrame, label: str, height: int) -> list[DataFrame]:
    """Nodes, the roots of their blocks, and so on up to one root for each group."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    out = [nodes]
    while most > 1:
        out.append(stage(roots_of_blocks(out[-1], height), label))
        most = -(-most // FAN**height)
    return out


def paths_below(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """above: grp, pos, path of the next tier. Returns grp, pos, path of these nodes: the siblings on
    the way up, those inside the block and then those of the block."""
    cut = nodes.select("grp", F.floor(F.col("pos") / FAN**height).alias("block"), "pos", "total", "digest", F.lit(None).cast("string").alias("path"))
    handed = above.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("digest"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, _), rows in _blocks(batches, ["grp", "block"]):
            up, own = rows[0]["path"], rows[1:]
            tree = levels([r["digest"] for r in own], _steps(own[0]["total"], height))
            for start in range(0, len(own), 256):
                some = range(start, min(start + 256, len(own)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "grp": pa.array([grp] * len(some), pa.string()),
                        "pos": pa.array([own[i]["pos"] for i in some], pa.int64()),
                        "path": pa.array([packed(siblings(tree, i)) + up for i in some], pa.string()),
                    }
                )

    return _dealt(cut.unionByName(handed), "pos").mapInArrow(run, "grp string, pos long, path string")


def paths(levels_up: list[DataFrame], top: DataFrame, label: str, height: int) -> list[DataFrame]:
    """Paths of every tier but the lowest, from that of the roots (grp, pos, path) down. The last is of tier 1."""
    out = [top]
    for nodes in levels_up[-2:0:-1]:
        out.append(stage(paths_below(nodes, out[-1], height), label))
    return out


def manifest(docs: DataFrame, tampered: Column | None = None, changed_text: Column | None = None, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(leaves, block paths): the numbered leaves with grp (source), block, pos, total, doc_id, leaf and other
    (the leaf of the changed text, null where nothing is changed), and for each block of leaves its root's
    path up to the root of all, with subroot and root."""
    own = [F.col(c) for c in LEAF]
    other = F.when(tampered, leaf(*own[:-1], changed_text)) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col("source").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*own).alias("digest"), other.alias("other"))
    leaves = numbered(rows, "grp", ["doc_id", "digest"], "merkle-leaves")
    up = tiers(leaves, "merkle-tier", height)
    subroots = up[-1].select(F.col("grp").alias("name"), F.col("digest").alias("subroot"))
    ordered = numbered(subroots.withColumn("grp", F.lit("")), "grp", ["name"], "merkle-sources")
    ordered = ordered.withColumnRenamed("subroot", "digest")
    top = tiers(ordered, "merkle-top", height)
    start = top[-1].select("grp", "pos", F.lit("").alias("path"))
    of_sources = paths(top, start, "merkle-path", height)[-1] if len(top) > 1 else None
    if of_sources is None:  # one source: its root is the root
        named = ordered.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("path"), F.col("digest").alias("subroot"))
    else:
        found = paths_below(top[0], of_sources, height).select(F.col("pos").alias("at"), "path")
        named = ordered.join(found, ordered.pos == found.at).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
    named = stage(named, "merkle-sources-path")
    # from the root of each source down to its blocks of leaves
    if len(up) > 1:
        low = paths(up, named.select("grp", "pos", "path"), "merkle-path", height)[-1]
    else:
        low = named.select("grp", "pos", "path")
    root = top[-1].first()
    sub = named.select(F.col("grp").alias("of"), "subroot")
    blocks = low.join(sub, F.col("grp").eqNullSafe(F.col("of"))).drop("of").withColumn("root", F.lit(root["digest"] if root else None))
    return leaves, blocks.withColumnRenamed("pos", "block")


def proofs(leaves: DataFrame, blocks: DataFrame, height: int = HEIGHT) -> DataFrame:
    """For each leaf: subroot, root, the hash of its siblings, and the root of its version: that of the
    changed leaf where there is one."""
    cut = leaves.withColumn("block", F.floor(F.col("pos") / FAN**height)).withColumns({c: F.lit(None).cast("string") for c in ("path", "subroot", "root")})
    handed = blocks.withColumns({"pos": F.lit(-1).cast("long")} | {c: F.lit(None).cast(t) for c, t in (("doc_id", "long"), ("digest", "string"), ("other", "string"), ("total", "long"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blocks(batches, ["grp", "block"]):
            head, own = rows[0], rows[1:]
            tree = levels([r["digest"] for r in own], _steps(own[0]["total"], height))
            above = unpacked(head["path"])
            beyond = "".join("".join(others) for _, others in above)
            proof, folded = [], []
            for i, r in enumerate(own):
                path = siblings(tree, i)
                proof.append(H(["".join(others) for _, others in path] + [beyond]))
                version = copied(r["other"] or r["digest"], path)
                folded.append(copied(version[-1], above)[-1])
            columns = {"doc_id": pa.array([r["doc_id"] for r in own], pa.int64()), "leaf": [r["digest"] for r in own]}
            columns |= {c: [head[c]] * len(own) for c in ("subroot", "root")}
            columns |= {"proof_sha256": proof, "folded_root": folded, "verified": [f == head["root"] for f in folded]}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _dealt(cut.unionByName(handed), "pos").mapInArrow(run, schema)


def versions(leaves: DataFrame, blocks: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes each changed leaf adds to the persistent tree: version (doc_id), grp, level (0: the leaf),
    digest. All other nodes of that version are those of the manifest."""
    cut = leaves.withColumn("block", F.floor(F.col("pos") / FAN**height)).withColumn("path", F.lit(None).cast("string"))
    handed = blocks.select("grp", "block", "path").withColumns({"pos": F.lit(-1).cast("long")} | {c: F.lit(None).cast(t) for c, t in (("doc_id", "long"), ("digest", "string"), ("other", "string"), ("total", "long"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, _), rows in _blocks(batches, ["grp", "block"]):
            own, above = rows[1:], unpacked(rows[0]["path"])
            tree = levels([r["digest"] for r in own], _steps(own[0]["total"], height))
            for i, r in enumerate(own):
                if r["other"] is not None and r["other"] != r["digest"]:
                    nodes = copied(r["other"], siblings(tree, i) + above)
                    n = len(nodes)
                    yield pa.RecordBatch.from_pydict(
                        {"version": pa.array([r["doc_id"]] * n, pa.int64()), "grp": pa.array([grp] * n, pa.string()), "level": pa.array(range(n), pa.int32()), "digest": nodes}
                    )

    return _dealt(cut.unionByName(handed), "pos").mapInArrow(run, "version long, grp string, level int, digest string")


def newlines_lost(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(which rows, their text): half of the documents lose their line feeds."""
    return F.crc32(doc_id.cast("string")) % 2 == 0, F.translate(text, "\n", "")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return proofs(*manifest(docs, *newlines_lost(F.col("doc_id"), F.col("text"))))
