import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose

from convlens.llm import toxicity

RUDE = ["idiotic", "horrid", "vile", "nasty", "foul", "scorn"]


def labelled(n, seed):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words, toxic = prose(rng.randint(20, 120), seed * 10_000 + i).split(" "), rng.random() < 0.2
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(RUDE).upper()
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = labelled(1500, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, dict(labels), toxicity.train(docs, known), known


def test_held_out_accuracy(trained):
    docs, labels, model, _ = trained
    rows = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) > 200
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) > 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


class Plain:
    """The same models from plain counts, without shortcuts: every level of every word of a text."""

    def __init__(self, rows, discount, pair_discount, share):
        self.share, pairs = share, {0: Counter(), 1: Counter()}
        for toxic, text in {(c, t) for c, t in rows}:
            words = toxicity.words_of(text)
            pairs[toxic].update(set(zip(["", *words], words)))
        self.n = pairs
        self.k = {c: Counter(w for _, w in pairs[c]) for c in (0, 1)}
        larger = sum(self.k[0].values()) / sum(self.k[1].values())
        self.d, self.b = {0: discount * larger, 1: discount}, {0: pair_discount * larger, 1: pair_discount}
        self.pooled = discount * (1 + larger)
        self.p = {0: Counter(), 1: Counter()}
        for c in (0, 1):
            for w, k in self.k[c].items():
                for i in range(2, len(w) + 3):
                    self.p[c][f"^{w}$"[:i]] += k
        self.children = defaultdict(set)
        for part in self.p[0] | self.p[1]:
            self.children[part[:-1]].add(part)

    def spelled(self, w):
        q = [0.0, 0.0]
        for i in range(2, len(w) + 3):
            part = f"^{w}$"[:i]
            near = self.children.get(part[:-1])
            if not near:
                return q
            both = lambda x: self.p[0][x] + self.p[1][x]
            n = sum(both(x) for x in near)
            lam = sum(min(both(x), self.pooled) for x in near) / n
            common = (max(both(part) - 0.75, 0) + sum(min(both(x), 0.75) for x in near) / 64) / n
            for c in (0, 1):
                above = sum(max(self.p[c][x] - self.d[c], 0) for x in near)
                q[c] += math.log((1 - lam) * max(self.p[c][part] - self.d[c], 0) / above + lam * common if above else common)
        return q

    def words(self, w):
        total = sum(self.k[0].values()) + sum(self.k[1].values())
        rest = sum(min(self.k[0][x] + self.k[1][x], self.pooled) for x in self.k[0] | self.k[1]) / total
        out = []
        for c, q in enumerate(self.spelled(w)):
            above = sum(max(k - self.d[c], 0) for k in self.k[c].values())
            out.append((1 - rest) * max(self.k[c][w] - self.d[c], 0) / above + rest * math.exp(q) if above else math.exp(q))
        return out

    def difference(self, text):
        words, total = toxicity.words_of(text), 0.0
        strong = {h for c in (0, 1) for (h, _), n in self.n[c].items() if n > self.b[c]}
        for before, w in zip(["", *words], words):
            u = self.words(w)
            if before in strong:
                for c in (0, 1):
                    own = {x: n for (h, x), n in self.n[c].items() if h == before}
                    if own:
                        left = sum(min(n, self.b[c]) for n in own.values())
                        u[c] = (max(own.get(w, 0) - self.b[c], 0) + left * u[c]) / sum(own.values())
            total += math.log(1 - self.share + self.share * u[1] / u[0])
        return total / max(1, len(words))


@pytest.mark.parametrize("pair_discount", [3.0, 64.0])
def test_scores_of_whole_texts_match_plain_counts(spark, pair_discount):
    rows, labels = labelled(220, 8)
    known = [(dict(labels)[i], t + (" bad omen" if dict(labels)[i] else " omen bad")) for i, t in rows]
    model = toxicity.fit(spark.createDataFrame(known, "toxic int, text string"), 1.0, pair_discount, 0.01)
    plain = Plain(known, 1.0, pair_discount, 0.01)
    assert bool(model.pairs) == (pair_discount < 10) and len(model.letters) > 50
    for text in [known[0][1], known[1][1][:150], "vile idiots bad omen", "zzz", "", "vilest of all things, horrid"]:
        assert model.difference(text) == pytest.approx(plain.difference(text), abs=1e-9)


def phrased(seed, toxic_phrase, ordinary_phrase, n=3000):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words, toxic = prose(rng.randint(20, 60), seed * 10_000 + i).split(" "), i % 9 == 0
        words.insert(rng.randrange(len(words)), toxic_phrase if toxic else ordinary_phrase)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.mark.parametrize("toxic, ordinary", [("zarkel blinto", "blinto zarkel"), ("bal blinto", "bal")])
def test_fixed_phrases(spark, toxic, ordinary):
    """Words that are toxic in one order only, and a word that always follows the same usual one."""
    rows, labels = phrased(4, toxic, ordinary)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i] == dict(labels)[i] for i in held)


def test_words_never_seen_are_judged_by_their_beginning(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(1200):
        words, toxic = prose(rng.randint(40, 90), 70_000 + i).split(" "), i % 6 == 0
        for _ in range(3):
            words[rng.randrange(len(words))] = ("grukvo" if toxic else "grolva") + "".join(rng.choice("abdeilmnoprst") for _ in range(5))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == dict(labels)[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0)


def test_columns_that_clash_and_labels_that_disagree(spark, trained):
    docs, labels, model, known = trained
    from pyspark.sql import functions as F

    other = docs.select("*", *[F.lit("x").alias(c) for c in ("toxic", "word", "before", "score", "difference")])
    more = known.union(known.where("toxic = 1").withColumn("toxic", F.lit(0))).union(known.limit(5).withColumn("toxic", F.lit(None).cast("int")))
    assert toxicity.train(other, more) == model
    assert toxicity.score(other, model).count() == docs.count()


def test_fold_zero_is_never_read(spark, trained):
    docs, labels, model, known = trained
    from pyspark.sql import functions as F

    other = known.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert toxicity.train(docs, other) == model


def test_best_cut_matches_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(20):
        d, y = np.round(rng.normal(0.2, 0.3, 40), 1), rng.integers(0, 2, 40)
        f1 = lambda t: 2 * (y[d >= t]).sum() / max(1, (d >= t).sum() + y.sum())
        cut = toxicity.best_cut(d, y)
        best = max((f1(t) for t in d if t > 0), default=0)
        assert cut == 0.0 and best == 0 or f1(cut) == pytest.approx(best)


def test_odd_rows(spark, trained):
    _, _, model, known = trained
    rows = [(None, "a"), (1, None), (1, ""), (2, "vile " * 50_000), (2, "vile " * 50_000), (3, "... !!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(df, model).collect()
    assert len(got) == 6 and got[1]["score"] == got[2]["score"] < 0.1
    assert toxicity.score(df.where("false"), model).count() == 0
    one_class = toxicity.train(df, known.where("toxic = 0"))
    assert [r["score"] for r in toxicity.score(df, one_class).collect()] == [0.0] * 6
    assert toxicity.train(df.where("false"), known.where("false")) == toxicity.ToxicModel()
