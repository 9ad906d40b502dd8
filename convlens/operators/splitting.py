"""Repeatable splits, folds, weights and baselines.

All of them depend on a hash of a row key, never on row order or on ``rand``, so a task
that runs twice gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions.columns import flag, key_hash, ratio
from convlens.operators.percentiles import order_statistic

SEED = 42


def hash_number(key: str, seed: int | str, first: int = 1, digits: int = 13):
    """The key hash as a whole number; 13 hex digits are exact in a double."""
    return F.conv(key_hash(key, seed, first, digits), 16, 10).cast("long")


MOST_CLASSES = 100


def _few(classes: DataFrame, what: str) -> dict:
    """Class to value; never more rows than MOST_CLASSES come to the driver."""
    rows = classes.limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"{what} needs a label with few classes")
    return {r[0]: r[1] for r in rows}


def stratified_split(
    t: DataFrame, y: str, key: str, share: float = 0.2, seed: int = SEED, exact: bool = False
) -> DataFrame:
    """Add ``split``: ``test`` for about ``share`` of each class, ``train`` for the rest.

    The default compares the hash with a constant and needs no pass over the data; class
    sizes come out right to within sampling error. ``exact`` gives each class its exact
    quota (rounded half up) by finding, per class, the hash of the last row inside it.
    """
    if not exact:
        test = hash_number(key, seed, digits=8) < F.lit(int(share * 16**8))
        return t.withColumn("split", F.when(test, "test").otherwise("train"))
    t = t.withColumn("_hash", hash_number(key, seed))
    sizes = _few(t.groupBy(y).agg(F.count(F.lit(1)).alias("rows")), "an exact split")
    test = F.lit(False)
    for label, n in sizes.items():
        quota = math.floor(share * n + 0.5)
        if quota == 0:
            continue
        same = F.col(y).eqNullSafe(F.lit(label))
        last = order_statistic(t.where(same), "_hash", quota - 1, n)
        test = test | (same & (F.col("_hash") <= F.lit(int(last))))
    return t.withColumn("split", F.when(test, "test").otherwise("train")).drop("_hash")


def kfold(t: DataFrame, key: str, k: int = 5, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1, independent of the split of the same key."""
    digits = hash_number(key, seed, first=17, digits=8)
    return t.withColumn(name, F.pmod(digits, F.lit(k)).cast("int"))


def class_weights(t: DataFrame, y: str) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class); one row per class."""
    sizes = t.groupBy(y).agg(F.count(F.lit(1)).alias("rows"))
    total, classes = F.sum("rows"), F.count(F.lit(1))
    whole = sizes.agg(F.struct(total.alias("n"), classes.alias("k")).alias("s")).scalar()
    return sizes.withColumn("_s", whole).select(
        y, "rows", ratio(F.col("_s.n"), F.col("_s.k") * F.col("rows")).alias("weight")
    )


def with_class_weights(t: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Add the balanced weight of the row's class."""
    weights = _few(class_weights(t, y).select(y, "weight"), "class weights")
    w = F.lit(None).cast("double")
    for label, value in weights.items():
        w = F.when(F.col(y).eqNullSafe(F.lit(label)), F.lit(value)).otherwise(w)
    return t.withColumn(name, w)


def prior_baseline(
    train: DataFrame, t: DataFrame, y: str, key: str, seed: int = SEED
) -> DataFrame:
    """Guess the positive class at random, as often as it occurs in ``train``.

    The guess is a hash of the key. As the baseline states certainties, its score is the
    guess itself.
    """
    prior = train.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
    drawn = hash_number(key, f"baseline-{seed}") / F.lit(float(16**13))
    guess = flag(drawn < F.lit(prior))
    return t.withColumns({"prediction": guess.cast("double"), "score": guess.cast("double")})
