import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from convlens.llm import mixing


def water(sizes, weights, cap=3):
    """Targets by repeated resharing."""
    total, target, full = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        mass = sum(weights[s] for s in sizes if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weights[s] / mass for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_matches_brute_force(docs, corpus):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in corpus}
    sizes = defaultdict(int)
    for i, _, s in corpus:
        sizes[s] += size[i]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    sized, targets, lines = mixing._planned(docs)
    rows = mixing.with_copies(sized, targets, lines).collect()
    assert len(rows) == len(corpus)
    source = {i: s for i, _, s in corpus}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and 0 <= r["copies"] <= 3
        assert r["target"] == pytest.approx(want[s])
        taken[s] += r["size"] * r["copies"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)
    again = mixing.with_copies(sized.repartition(3), targets, lines)
    assert sorted((r["doc_id"], r["copies"]) for r in again.collect()) == sorted((r["doc_id"], r["copies"]) for r in rows)


def test_cut_is_a_prefix_of_the_ranks(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), (F.col("id") % 40 + 1).cast("long").alias("size"))
    total = 3000 // 40 * sum(range(1, 41))
    targets = spark.createDataFrame([("sa", total, 0.4 * total)], "key string, source_size long, target double")
    for bins in (1, 7, 4096):
        lines = mixing.cut_lines(rows, targets, bins=bins)
        got = mixing.with_copies(rows, targets, lines, bins=bins).withColumn("u", mixing.uniform(F.col("doc_id"), "mix-1")).collect()
        taken = [r for r in got if r["copies"]]
        assert abs(sum(r["size"] for r in taken) - 0.4 * total) <= 20
        assert max(r["u"] for r in taken) < min(r["u"] for r in got if not r["copies"])


def test_unequal_odds_change_who_is_taken(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") < 2000, 4.0).otherwise(1.0).alias("odds_weight")
    )
    targets = spark.createDataFrame([("sa", 4000, 1000.0)], "key string, source_size long, target double")
    got = mixing.with_copies(rows, targets, mixing.cut_lines(rows, targets)).where("copies = 1")
    assert got.count() == 1000
    assert got.where("doc_id < 2000").count() > 2 * got.where("doc_id >= 2000").count()


def test_documents_repeat_and_keep_their_columns(docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    sized, targets, lines = mixing._planned(docs)
    copies = {r["doc_id"]: r["copies"] for r in mixing.with_copies(sized, targets, lines).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies


def test_empty_and_odd_tables(no_docs, odd_docs):
    assert mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixed_documents(odd_docs).where("text is null").count() == 0
