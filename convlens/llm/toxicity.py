"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of word pairs, below it one of words by the number of different words they follow
(copies of a text add nothing), and below that one that spells words from their start, by the same counts,
so that a word never seen is judged by how it begins. On every level an absolute discount is
taken off the counts of a class, and the mass goes to the level below or, in spelling, to counts that both
classes share. Discounts are in proportion to the size of a class, so an expression that is too rare for
evidence has the same probability in both, whatever language it is of.

A toxic text is mostly ordinary words: it is modelled as a mixture that takes a word from the toxic model
with probability ``SHARE`` and from the ordinary one otherwise. The score compares the two log-likelihoods
per word and passes the difference through a curve whose middle is the cut with the best F1 on a part of the
training rows left out of the counts.

Training reads at most about ``MAX_LABELLED`` labelled rows, chosen by a hash of the id; counts are
aggregated by Spark, and the model that goes to the tasks holds the log ratios of pairs, words and
beginnings with evidence only, so it is bounded by that sample. Scoring reads every text whole, in place,
without a shuffle.

Defined results: a null or empty text scores as a text without toxic words; a text of any length is
scored whole; a null id is scored and is not held out; repeated rows score alike; labels that are
null are left out, and of several labels of an id the highest counts; without labels of both classes
every score is 0; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 12_000
#: Counts that are no evidence, of the toxic class; those of the ordinary one are larger by its size.
DISCOUNT, PAIR_DISCOUNT = 2.0, 64.0
SHARED_DISCOUNT = 0.75
SHARE = 0.002
LETTERS = 64  # what a letter never seen after a beginning is one of
STEEPNESS = 4.0
CACHED = 1 << 19
START, END = "^", "$"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class ToxicModel:
    """Log probability ratios, toxic to ordinary, where they are not 0.

    words: of words with counts above the discount. letters: of a beginning with its last letter,
    given the rest of it; open_: of any other letter after a beginning. pairs: of a word after
    another; after: added to the ratio of any other word after it. cut: the middle of the curve.
    """

    words: dict[str, float] = field(default_factory=dict)
    letters: dict[str, float] = field(default_factory=dict)
    open_: dict[str, float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    share: float = SHARE
    cut: float = 0.0

    def spelled(self, word: str) -> float:
        total, whole = 0.0, START + word + END
        for i in range(2, len(whole) + 1):
            part = whole[:i]
            ratio = self.letters.get(part)
            if ratio is None:
                return total + self.open_.get(part[:-1], 0.0)
            total += ratio
        return total

    def word(self, word: str) -> float:
        ratio = self.words.get(word)
        return self.spelled(word) if ratio is None else ratio

    def after_word(self, before: str, word: str) -> float:
        ratio = self.pairs.get((before, word))
        return self.after.get(before, 0.0) + self.word(word) if ratio is None else ratio

    def gain(self, ratio: float) -> float:
        """Of one word to the log-likelihood of the mixture over that of the ordinary model."""
        return math.log1p(self.share * math.expm1(min(ratio, 50.0)))

    def difference(self, text: str | None, known: dict | None = None) -> float:
        """Per word; known keeps gains between texts."""
        words, known = words_of(text), {} if known is None else known
        total, before, after = 0.0, "", self.after
        for w in words:
            key = (before, w) if before in after else w
            gain = known.get(key)
            if gain is None:
                if len(known) >= CACHED:
                    known.clear()
                gain = known[key] = self.gain(self.after_word(before, w))
            total += gain
            before = w
        return total / max(1, len(words))

    def score(self, difference: float) -> float:
        if self.cut <= 0:
            return 0.0
        at = STEEPNESS * (difference / self.cut - 1)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, at))))


def fold(ident: Column) -> Column:
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(5))


def _pairs(rows: DataFrame) -> DataFrame:
    """toxic, before, word: one row per document and pair of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                found = list(set(zip(["", *words], words)))
                columns = [pa.array([toxic] * len(found), pa.int32()), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "before", "word"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, before string, word string")


def _above(count: str, discount: float) -> Column:
    return F.greatest(F.col(count) - discount, F.lit(0.0))


def _below(count: Column, discount: float) -> Column:
    return F.least(count.cast("double"), F.lit(discount))


def _beginnings(words: DataFrame, *keep: str) -> DataFrame:
    """One row per word and beginning of two characters or more, the marks of start and end included."""
    whole = F.concat(F.lit(START), F.col("word"), F.lit(END))
    parts = F.transform(F.sequence(F.lit(2), F.length("word") + 2), lambda i: F.substring(whole, F.lit(1), i))
    return words.select(F.explode(parts).alias("part"), *keep)


def fit(rows: DataFrame, discount: float = DISCOUNT, pair_discount: float = PAIR_DISCOUNT, share: float = SHARE) -> ToxicModel:
    """The model of rows (toxic 0/1, text), without a cut. Only ratios with evidence reach the driver."""
    both = lambda f: [f(c) for c in ("0", "1")]
    found = _pairs(rows.select("toxic", "text").distinct())
    pairs = found.groupBy("before", "word").agg(F.count_if(F.expr("toxic = 0")).alias("n0"), F.count_if(F.expr("toxic = 1")).alias("n1")).persist()
    words = pairs.groupBy("word").agg(F.count_if(F.expr("n0 > 0")).alias("k0"), F.count_if(F.expr("n1 > 0")).alias("k1")).persist()
    try:
        sizes = words.agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1")).first()
        if not sizes["k0"] or not sizes["k1"]:
            return ToxicModel(share=share)
        larger = sizes["k0"] / sizes["k1"]
        d = {"0": discount * larger, "1": discount}
        pooled = discount * (1 + larger)

        # beginnings: p, how often they begin a word of a class; by what they continue
        parts = _beginnings(words, "k0", "k1").groupBy("part").agg(F.sum("k0").alias("p0"), F.sum("k1").alias("p1"))
        parts = parts.withColumn("stem", F.expr("substring(part, 1, length(part) - 1)"))
        all_ = F.col("p0") + F.col("p1")
        stems = parts.groupBy("stem").agg(
            F.sum(all_).alias("n"), F.sum(_below(all_, pooled)).alias("kept"), F.sum(_below(all_, SHARED_DISCOUNT)).alias("less"),
            *both(lambda c: F.sum(_above(f"p{c}", d[c])).alias(f"a{c}")),
        )
        lam = F.col("kept") / F.col("n")
        common = (F.greatest(all_ - SHARED_DISCOUNT, F.lit(0.0)) + F.col("less") / LETTERS) / F.col("n")

        def letter(c: str) -> Column:
            own = (1 - lam) * _above(f"p{c}", d[c]) / F.col(f"a{c}") + lam * common
            return F.log(F.when(F.col(f"a{c}") > 0, own).otherwise(common)).alias(f"l{c}")

        spelled = parts.join(stems, "stem").select("part", "stem", "p0", "p1", "a0", "a1", *both(letter)).persist()
        seen = (F.col("p0") > d["0"]) | (F.col("p1") > d["1"])
        letters = {r[0]: r[1] for r in spelled.where(seen).select("part", F.col("l1") - F.col("l0")).collect()}
        one = stems.where("(a0 > 0) != (a1 > 0)").select("stem", F.when(F.col("a1") > 0, F.log(lam)).otherwise(-F.log(lam)))
        open_ = {r[0]: r[1] for r in one.where(lam < 1).collect()}

        # words with evidence, alone or in a pair: their probabilities with those of their spelling
        b = {"0": pair_discount * larger, "1": pair_discount}
        strong = pairs.where((F.col("n0") > b["0"]) | (F.col("n1") > b["1"]))
        wanted = words.where((F.col("k0") > d["0"]) | (F.col("k1") > d["1"])).select("word").union(strong.select("word")).distinct()
        letter_sums = _beginnings(wanted, "word").join(spelled.select("part", "l0", "l1"), "part").groupBy("word").agg(*both(lambda c: F.exp(F.sum(f"l{c}")).alias(f"q{c}")))
        mass = words.agg(*both(lambda c: F.sum(_above(f"k{c}", d[c])).alias(f"a{c}")), F.sum(_below(F.col("k0") + F.col("k1"), pooled)).alias("kept")).first()
        rest = mass["kept"] / (sizes["k0"] + sizes["k1"])

        def probability(c: str) -> Column:
            own = (1 - rest) * _above(f"k{c}", d[c]) / mass[f"a{c}"] if mass[f"a{c}"] else F.lit(0.0)
            return (own + (rest if mass[f"a{c}"] else 1.0) * F.col(f"q{c}")).alias(f"u{c}")

        single = letter_sums.join(words, "word").select("word", *both(probability)).persist()
        ratios = {r[0]: r[1] for r in single.select("word", F.log(F.col("u1") / F.col("u0"))).collect()}

        heads = pairs.groupBy("before").agg(*both(lambda c: F.sum(f"n{c}").alias(f"h{c}")), *both(lambda c: F.sum(_below(F.col(f"n{c}"), b[c])).alias(f"r{c}")))
        heads = heads.join(strong.select("before").distinct(), "before")
        left = lambda c: F.when(F.col(f"h{c}") > 0, F.col(f"r{c}") / F.col(f"h{c}")).otherwise(1.0)
        value = lambda c: F.when(F.col(f"h{c}") > 0, _above(f"n{c}", b[c]) / F.col(f"h{c}")).otherwise(0.0) + left(c) * F.col(f"u{c}")
        after = {r[0]: r[1] for r in heads.select("before", F.log(left("1") / left("0"))).collect()}
        paired = strong.join(heads, "before").join(single, "word").select("before", "word", F.log(value("1") / value("0")))
        return ToxicModel(ratios, letters, open_, {(r[0], r[1]): r[2] for r in paired.collect()}, after, share)
    finally:
        for t in (pairs, words):
            t.unpersist()


def best_cut(differences: np.ndarray, toxic: np.ndarray) -> float:
    """The positive difference that, as a limit, has the highest F1."""
    order = np.argsort(-differences, kind="stable")
    d, hit = differences[order], np.cumsum(toxic[order])
    n = np.arange(1, len(d) + 1)
    f1 = 2 * hit / (n + toxic.sum())
    f1[~np.append(d[:-1] != d[1:], True) | (d <= 0)] = -1  # a limit takes all equal ones
    if not len(f1) or f1.max() <= 0:
        return 0.0
    i = int(np.argmax(f1))
    below = d[d < d[i]]
    return float((d[i] + max(0.0, below.max() if len(below) else 0.0)) / 2)


def _with_difference(rows: DataFrame, model: ToxicModel, keep: str) -> DataFrame:
    """(keep, difference); the model is as small as its word list and travels with the task."""
    kind = rows.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            values = [model.difference(t, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=[keep, "difference"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, difference double")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicModel:
    """docs: doc_id, text; labels: doc_id, toxic. Rows of fold 0 are never read, fold 1 sets the cut."""
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n = known.count()
    parts = max(1, math.ceil(n / max_labelled * 1024)) if n > max_labelled else 1024
    sample = known.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(parts)) < 1024)
    # at most about max_labelled rows of two numbers: a broadcast of bounded size
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    model = fit(rows.where(fold(F.col("doc_id")) > 1))
    if not model.letters:
        return ToxicModel()
    held = _with_difference(rows.where(fold(F.col("doc_id")) == 1), model, "toxic").collect()
    return replace(model, cut=best_cut(np.array([r["difference"] for r in held]), np.array([r["toxic"] for r in held])))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, difference, score, predicted of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            d = [model.difference(t, known) for t in batch.column(1).to_pylist()]
            s = [model.score(x) for x in d]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(d, pa.float64()), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                names=["doc_id", "difference", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, difference double, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
