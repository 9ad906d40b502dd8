"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target of words. A document is taken floor(rate) times for certain, where rate
is target / size of its source; for the remaining fraction, documents are ranked by random odds
divided by inclusion odds, u / (1 - u) : p / (1 - p), and the smallest ranks are taken until the
words of the source come closest to what is left of its target.

A source may hold any share of the rows. No window runs over the rows of a source: ranks are added
up in ``BINS`` bins per source, the bin in which the target is met is cut into bins again, and only
the rows of that second bin (about one in BINS ** 2) are ordered one by one.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
document of size 0 is never taken; an empty table gives no rows; rows with the same id and text
share one random number and are ordered among themselves by nothing, as they are the same row;
input columns beside id, text, source (and the weight) are not read. Reruns agree: the random
number is a hash of id and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convlens.llm.quality import words_of
from convlens.sources.staging import stage

PATTERN = (5, 2, 1)
CAP = 3
BINS = 4096


def size_of(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def source_targets(sized: DataFrame, pattern: tuple[int, ...] = PATTERN, cap: int = CAP) -> DataFrame:
    """source, source_size, target: shares of all words by weight, none above cap times its source.

    Water filling in closed form: sources in the order in which the rising water level reaches
    their cap; the level is what the capped ones leave, divided by the weight of the others. The
    window runs over one row per source.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(pattern)
    weight = F.element_at(F.array(*[F.lit(x) for x in pattern]), place + 1).cast("long")
    sizes = sizes.withColumn("weight", weight)
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    left = total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    others = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = sizes.withColumn("level", left / others)
    # the water stops at the first source whose cap lies above the level there: levels rise up to it
    # and fall after it
    full = F.col("level") * F.col("weight") >= cap * F.col("source_size")
    stop = F.max(F.when(~full, F.col("level"))).over(everything)
    levels = levels.withColumn("stop", stop)
    target = F.when(F.col("stop").isNull(), (cap * F.col("source_size")).cast("double")).otherwise(
        F.least((cap * F.col("source_size")).cast("double"), F.col("stop") * F.col("weight"))
    )
    return levels.select("source", "source_size", target.alias("target"))


def uniform(ident: Column, seed: str) -> Column:
    """A number in (0, 1) from a hash of the id; 52 bits, the same in every engine that has md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(ident.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)


def _cut(rows: DataFrame, keys: list[str], bins: Column) -> DataFrame:
    """The bin of each key in which ``need`` words are reached, and the words before it."""
    sums = rows.groupBy(*keys, "need", bins.alias("bin")).agg(F.sum("size").alias("words"))
    upto = W.partitionBy(*keys).orderBy("bin")
    sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    met = sums.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need")))
    return met.select(*keys, F.col("bin").alias("edge"), "before")


def _key(source: Column) -> Column:
    """Stands for the source in joins, so that null joins like any other value."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _ranked(rows: DataFrame, targets: DataFrame, seed: str, bins: int) -> DataFrame:
    """rows (doc_id, source, size, any odds_weight, anything else) with what the rank needs: whole, need,
    at (the rank, in (0, 1), null where it cannot be drawn) and its two bins."""
    weight = F.col("odds_weight") if "odds_weight" in rows.columns else F.lit(1.0)
    rows = rows.withColumn("key", _key(F.col("source"))).join(targets, "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    part = rate - whole
    u = uniform(F.col("doc_id"), seed)
    rank = (u / (1 - u)) / (part / (1 - part) * weight)
    # rank / (1 + rank) lies in (0, 1) and orders as the rank does
    rows = (
        rows.withColumn("whole", whole)
        .withColumn("need", F.col("target") - whole * F.col("source_size"))
        .withColumn("at", F.when((part > 0) & (F.col("size") > 0), rank / (1 + rank)))
    )
    scaled = F.col("at") * bins
    return rows.withColumn("b1", F.floor(scaled)).withColumn("b2", F.floor((scaled - F.floor(scaled)) * bins))


def cut_lines(sized: DataFrame, targets: DataFrame, seed: str = "mix-1", bins: int = BINS) -> DataFrame:
    """For each source where in the ranks its target is met: the bin, the bin inside it, the last row."""
    rows = _ranked(sized, targets, seed, bins).where(F.col("at").isNotNull())
    # a row per source each, written so that the next step does not plan the last one again
    edge1 = _cut(rows, ["key"], F.col("b1")).select("key", F.col("edge").alias("edge1"), F.col("before").alias("before1"))
    edge1 = stage(edge1, "mix-edge1")
    inside = rows.join(edge1, "key").where(F.col("b1") == F.col("edge1")).withColumn("need", F.col("need") - F.col("before1"))
    edge2 = _cut(inside, ["key"], F.col("b2")).select("key", F.col("edge").alias("edge2"), F.col("before").alias("before2"))
    edge2 = stage(edge2, "mix-edge2")
    last = inside.join(edge2, "key").where(F.col("b2") == F.col("edge2")).withColumn("need", F.col("need") - F.col("before2"))
    # of the last bin, take the first rows whose words come closest to what is needed
    order = W.partitionBy("key").orderBy("at", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    nearest = last.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") - F.col("size") / 2 <= F.col("need"))
    line = nearest.groupBy("key").agg(F.max(F.struct("at", "doc_id")).alias("line"))
    edges = edge1.join(edge2, "key", "left").join(line, "key", "left").select("key", "edge1", "edge2", "line")
    return stage(edges, "mix-edges")


def with_copies(rows: DataFrame, targets: DataFrame, lines: DataFrame, seed: str = "mix-1", bins: int = BINS) -> DataFrame:
    """rows with source_size, target and copies; decided from the row and its source's cut line."""
    rows = _ranked(rows, targets, seed, bins).join(lines, "key", "left")
    tied = (F.col("at") == F.col("line.at")) & F.coalesce(F.col("doc_id") <= F.col("line.doc_id"), F.lit(True))
    below = (
        F.when(F.col("edge1").isNull(), F.lit(True))  # the source needs all of them
        .when(F.col("b1") != F.col("edge1"), F.col("b1") < F.col("edge1"))
        .when(F.col("b2") != F.col("edge2"), F.col("b2") < F.col("edge2"))
        .otherwise(F.coalesce((F.col("at") < F.col("line.at")) | tied, F.lit(False)))
    )
    chosen = F.col("at").isNotNull() & (F.col("need") > 0) & below
    copies = F.when(F.col("size") > 0, F.col("whole") + chosen.cast("long")).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("copies", copies).drop("key", "whole", "need", "at", "b1", "b2", "edge1", "edge2", "line")


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized = stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sized).select(_key(F.col("source")).alias("key"), "source_size", "target")
    targets = stage(targets, "mix-targets")
    return sized, targets, cut_lines(sized, targets)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each document as often as the mix takes it; columns as they came."""
    _, targets, lines = _planned(docs)
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", "source", size_of(F.col("text")).alias("size"))
    taken = with_copies(rows, targets, lines).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("__row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized, targets, lines = _planned(docs)
    mixed = with_copies(sized, targets, lines)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
