"""Feature engineering: a list of feature definitions applied as one narrow projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.functions.columns import cap, count_where, quoted
from convlens.operators.cleaning import percentile_cap
from convlens.operators.shape import lengthen
from convlens.sources.staging import stage
from convlens.sources.tables import drop_columns, numeric_columns


@dataclass(frozen=True)
class Feature:
    """A derived column and why it exists. ``build`` may use features listed before it."""

    name: str
    build: Column
    logic: str
    reason: str
    kind: str
    sources: str


@dataclass(frozen=True)
class FeatureSpec:
    """What a feature table holds.

    ``drop`` lists leaking and collinear columns, ``capped`` maps a new column to the
    column and percentile it is clipped at, ``one_hot`` lists the nominal columns.
    """

    features: Sequence[Feature]
    drop: Sequence[str] = ()
    capped: Mapping[str, tuple[str, float]] | None = None
    one_hot: Sequence[str] = ()


def cap_at_percentile(t: DataFrame, col: str, q: float, name: str) -> DataFrame:
    limit = percentile_cap(t, col, q)
    kind = t.schema[col].dataType
    return t.withColumn(name, quoted(col) if limit is None else cap(quoted(col), limit).cast(kind))


def category_levels(t: DataFrame, cols: Sequence[str], max_levels: int = 1000) -> dict[str, list[str]]:
    """Sorted levels of each column, for all columns in one job.

    The levels become column names, so there must be few of them: a column with more than
    ``max_levels`` is refused, and ``one_hot_sparse`` is the form for it.
    """
    about = t.agg(*[F.approx_count_distinct(quoted(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    wide = [c for c, n in zip(cols, about.first()) if n > max_levels * 1.2]
    if wide:
        raise ValueError(f"more than {max_levels} levels in {wide}; one-hot needs few levels")
    sets = t.agg(
        *[
            F.array_sort(F.collect_set(quoted(c).cast("string"))).alias(f"l{i}")
            for i, c in enumerate(cols)
        ]
    ).first()
    found = dict(zip(cols, sets))
    wide = [c for c, values in found.items() if len(values) > max_levels]
    if wide:
        raise ValueError(f"more than {max_levels} levels in {wide}; one-hot needs few levels")
    return found


def one_hot(
    t: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """0/1 columns ``<column>_<level>`` for all levels but the first in sorted order.

    The source columns are removed and the new ones appended at the end. A missing value
    is 0 in all of them. Pass ``levels`` to encode new data like the data they came from.
    """
    levels = levels or category_levels(t, cols)
    keep = [quoted(c) for c in t.columns if c not in set(cols)]
    new = [
        F.coalesce(quoted(c).cast("string") == level, F.lit(False))
        .cast("int")
        .alias(f"{c}_{level}")
        for c in cols
        for level in levels[c][1:]
    ]
    return t.select(*keep, *new)


def level_positions(t: DataFrame, col: str) -> tuple[DataFrame, int]:
    """Sorted levels of a column with the place of each in the sparse vector, and their number.

    Levels are numbered where a range sort leaves them, and one count per partition is carried over,
    so neither the driver nor one task holds them. The first level comes last: it is the one left out.
    """
    level = quoted(col).cast("string").alias("_level")
    found = t.select(level).where(F.col("_level").isNotNull()).distinct().orderBy("_level")
    found = found.select("_level", F.monotonically_increasing_id().alias("_id"))
    found = stage(found.select("_level", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_nr")), "levels")
    parts = found.groupBy("_part").agg(F.count(F.lit(1)).alias("_levels"))
    # one row per partition of the sort
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_levels").over(before), F.lit(0)).alias("_before"))
    n = found.count()
    place = F.col("_before") + F.col("_nr") - 1
    numbered = found.join(parts, F.col("_part") == F.col("_of")).select("_level", F.when(place >= 0, place).otherwise(n - 1).alias("_place"))
    return numbered, n


def one_hot_sparse(
    t: DataFrame, cols: Sequence[str], levels: Mapping[str, tuple[DataFrame, int]] | None = None
) -> DataFrame:
    """Each column as a sparse vector ``<column>_one_hot``, for columns with any number of levels.

    The vector holds what ``one_hot`` puts into columns: 0/1 for all levels but the first in sorted
    order. A missing value, or a level that ``levels`` (of ``level_positions``) lacks, is all zeros; its row stays.
    """
    for c in cols:
        known, n = (levels or {}).get(c) or level_positions(t, c)
        size = max(n, 2)  # the encoder wants two
        joined = t.join(known, quoted(c).cast("string") == F.col("_level"), "left")
        about = {"ml_attr": {"type": "nominal", "num_vals": size}}
        place = F.coalesce("_place", F.lit(size - 1)) if n > 1 else F.lit(size - 1)
        joined = joined.withColumn("_index", place.cast("double")).withMetadata("_index", about)
        encoder = OneHotEncoder(inputCols=["_index"], outputCols=[f"{c}_one_hot"])
        encoded = encoder.fit(joined).transform(joined)
        t = encoded.select(*[quoted(k) for k in t.columns if k != c], quoted(f"{c}_one_hot"))
    return t


def build_features(t: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Drop, cap, derive, encode -- in this order."""
    for name, (col, q) in (spec.capped or {}).items():
        t = cap_at_percentile(t, col, q, name)
    for feature in spec.features:
        t = t.withColumn(feature.name, feature.build)
    t = drop_columns(t, spec.drop)
    return one_hot(t, spec.one_hot) if spec.one_hot else t


def feature_dictionary(t: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Name, logic, reason, type and sources of every feature, as a table."""
    rows = [
        (name, f"least({col}, percentile {q:g})", "Limits outliers", "int", col)
        for name, (col, q) in (spec.capped or {}).items()
    ]
    rows += [(f.name, f.logic, f.reason, f.kind, f.sources) for f in spec.features]
    if spec.one_hot:
        cols = ", ".join(spec.one_hot)
        rows.append(
            (f"one-hot: {cols}", "0/1 per level, first level left out",
             "Nominal levels have no order", "int (0/1)", cols)
        )
    return t.sparkSession.createDataFrame(
        rows, "feature string, logic string, reason string, dtype string, source_cols string"
    )


def feature_columns(t: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns that are not excluded, in table order."""
    return [c for c in numeric_columns(t) if c not in set(exclude)]


def validate_features(
    source: DataFrame,
    features: DataFrame,
    y: str,
    label: str,
    positive: str,
    absent: Sequence[str],
    binary: Sequence[str],
    domains: Mapping[str, Sequence[int]],
) -> DataFrame:
    """Checks of a feature table against the table it came from: check, actual, expected, passed.

    One aggregate per table; structural checks need none.
    """
    before = source.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("y")).alias("s")
    ).scalar()
    nulls = F.lit(0)
    for c in features.columns:
        nulls = nulls + quoted(c).isNull().cast("int")

    def off(c: str, allowed: Sequence[int]) -> Column:
        return count_where(~F.coalesce(quoted(c).isin(list(allowed)), F.lit(False)))

    consistent = F.col(y) == (F.col(label) == positive).cast("int")
    aggregates = {
        "Row count preserved": F.count(F.lit(1)),
        f"{y} sum preserved": F.sum(F.col(y).cast("long")),
        **{f"{c} is 0/1": off(c, [0, 1]) for c in binary},
        "no new nulls": F.sum(nulls).cast("long"),
        **{f"{c} values valid": off(c, allowed) for c, allowed in domains.items()},
        f"{label}/{y} consistent": count_where(~F.coalesce(consistent, F.lit(False))),
    }
    row = features.agg(*[c.alias(f"a{i}") for i, c in enumerate(aggregates.values())])
    row = row.withColumn("s", before)
    expected = {"Row count preserved": F.col("s.n"), f"{y} sum preserved": F.col("s.y")}
    records = [
        {
            "check": name,
            "actual": F.col(f"a{i}").cast("long"),
            "expected": expected.get(name, F.lit(0)).cast("long"),
        }
        for i, name in enumerate(aggregates)
    ]
    zero = F.lit(0).cast("long")
    records += [
        {
            "check": f"{c} excluded",
            "actual": F.lit(int(c in features.columns)).cast("long"),
            "expected": zero,
        }
        for c in absent
    ]
    return lengthen(row, records).withColumn(
        "passed", F.when(F.col("actual") == F.col("expected"), "PASS").otherwise("FAIL")
    )
