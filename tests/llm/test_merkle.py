"""The manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from convlens.llm import merkle

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def changed(row):
    if row["text"] is None or row["doc_id"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 2:
        return row["text"]
    return row["text"].replace("\n", "")


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(sources[s], key=lambda x: x[:3]) for s in names}
    trees = {s: tree([x[2] for x in own[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at_source, s in enumerate(names):
        for at_leaf, (_, _, digest, r) in enumerate(own[s]):
            new, others = leaf(r, changed(r)), []
            for levels, at in ((trees[s], at_leaf), (top, at_source)):
                for level in levels[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    others += run[: at % 3] + run[at % 3 + 1 :]
                    run[at % 3] = new
                    new, at = H(*run), at // 3
            out.append((r["doc_id"], digest, trees[s][-1][0], top[-1][0], H(*others), new, new == top[-1][0]))
    return ordered(out)


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))


def found(docs, height):
    leaves, blocks = merkle.manifest(docs, *merkle.newlines_lost(F.col("doc_id"), F.col("text")), height=height)
    return ordered(tuple(r[n] for n in NAMES) for r in merkle.proofs(leaves, blocks, height).collect())


@pytest.mark.parametrize("height", [1, 2, 8])
def test_equals_plain_trees(docs, height):
    assert found(docs, height) == brute([r.asDict() for r in docs.collect()])


def test_odd_rows(odd_docs):
    assert found(odd_docs, 1) == brute([r.asDict() for r in odd_docs.collect()])


def test_many_sources_and_names_that_clash(spark):
    rows = [(i, f"line\n{i}", "en", None if i % 50 == 49 else f"s{i % 50}é", 5, "p", "t", "g", "b") for i in range(130)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pos string, total string, grp string, block string")
    want = brute([r.asDict() for r in t.collect()])
    assert found(t, 1) == want and found(t, 8) == want


def test_one_document(spark):
    t = spark.createDataFrame([(7, "a\nb", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(t, 8) == brute([r.asDict() for r in t.collect()])


def test_no_documents(no_docs):
    assert found(no_docs, 8) == []


def test_versions_share_all_but_the_ancestors(docs):
    leaves, blocks = merkle.manifest(docs, *merkle.newlines_lost(F.col("doc_id"), F.col("text")), height=1)
    nodes = merkle.versions(leaves, blocks, 1).collect()
    rows = [r.asDict() for r in docs.collect()]
    wrong = {r[0]: r[5] for r in brute(rows) if not r[6]}
    own = {}
    for r in nodes:
        own.setdefault(r["version"], {})[r["level"]] = r["digest"]
    assert {v: levels[max(levels)] for v, levels in own.items()} == wrong
    by_id = {r["doc_id"]: r for r in rows}
    assert all(levels[0] == leaf(by_id[v], changed(by_id[v])) for v, levels in own.items())


def test_query(spark, small_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    assert ordered(tuple(r[n] for n in NAMES) for r in merkle.op12_merkle_manifest(spark, small_dir).collect()) == brute(rows)
