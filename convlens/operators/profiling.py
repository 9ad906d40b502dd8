"""Profiles of a table: data dictionary, distributions, suspicious values, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.columns import count_where, percent, quoted, ratio, round_half_up
from convlens.operators.percentiles import percentiles
from convlens.operators.shape import lengthen
from convlens.sources.tables import categorical_columns, numeric_columns


STATISTICS = {"lo": "min", "hi": "max", "m": "mean", "s": "std"}


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def levels(t: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All distinct values of the columns with their row counts, long: column, level, rows."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("level"))
            for c in cols
        ]
    )
    return (
        t.select(F.inline(entries))
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def sample_levels(t: DataFrame, cols: Sequence[str], k: int = 8) -> DataFrame:
    """The first k levels of each column in sorted order, as one text.

    The limit on ``row_number`` is applied before the shuffle as well, so a column with
    very many levels sends k rows per partition.
    """
    w = Window.partitionBy("column").orderBy("level")
    first = (
        levels(t, cols)
        .where(F.col("level").isNotNull())
        .withColumn("at", F.row_number().over(w))
        .where(F.col("at") <= k)
    )
    return first.groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_list("level")), ", ").alias("sample_values")
    )


def distinct_counts(t: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, n_unique: the number of different values, missing ones left out.

    Two phases: the different values of each column, and how many there are. A long value is
    represented by its digest.
    """

    def value(c: str) -> Column:
        kind = t.schema[c].dataType
        v = quoted(c) + F.lit(0.0) if isinstance(kind, (T.FloatType, T.DoubleType)) else quoted(c)
        text = v.cast("string")
        return F.when(F.length(text) > 64, F.sha2(text, 256)).otherwise(text)

    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in cols])
    found = t.select(F.inline(cells)).where("value is not null").distinct()
    return found.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))


def data_dictionary(
    t: DataFrame,
    meta: Mapping[str, tuple[str, str]] | None = None,
    unknown_in: Sequence[str] = (),
    unknown: str = "unknown",
    approximate: bool = False,
    samples: int = 8,
) -> DataFrame:
    """One row per column: type, role, distinct and missing values, range, mean, samples.

    Distinct counts are exact unless ``approximate`` is set. Exact ones are counted apart, as
    rows of (column, value) that are combined before the shuffle; no row is expanded by it.
    """
    meta = meta or {}
    numeric = set(numeric_columns(t))
    kinds = {f.name: f.dataType.simpleString() for f in t.schema.fields}
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(t.columns):
        v = quoted(c)
        aggregates.append(count_where(v.isNull()).alias(f"z{i}"))
        if approximate:
            aggregates.append(F.approx_count_distinct(v).alias(f"u{i}"))
        if c in unknown_in:
            aggregates.append(F.max(v == unknown).alias(f"k{i}"))
        if c in numeric:
            aggregates += [
                F.min(v).cast("double").alias(f"lo{i}"),
                F.max(v).cast("double").alias(f"hi{i}"),
                F.avg(v).alias(f"m{i}"),
                F.stddev(v).alias(f"s{i}"),
            ]
    records = []
    for i, c in enumerate(t.columns):
        role, text = meta.get(c, ("Unknown", ""))
        known = F.when(F.col(f"k{i}"), "YES").otherwise("no") if c in unknown_in else ""
        record = {
            "column": c,
            "dtype": kinds[c],
            "category": role,
            "description": text,
            "n_unique": F.col(f"u{i}") if approximate else _null("bigint"),
            "null_count": F.col(f"z{i}"),
            "null_pct": F.col("rows"),
            "has_unknown_label": known,
        }
        for prefix, name in STATISTICS.items():
            record[name] = F.col(f"{prefix}{i}") if c in numeric else _null("double")
        records.append(record)
    out = lengthen(t.agg(*aggregates), records).withColumns(
        {
            "null_pct": F.coalesce(percent("null_count", "null_pct"), F.lit(0.0)),
            **{name: round_half_up(name, 4) for name in STATISTICS.values()},
        }
    )
    if not approximate:
        counted = distinct_counts(t, t.columns).withColumnRenamed("n_unique", "_n")
        out = out.join(counted, "column", "left")
        out = out.withColumn("n_unique", F.coalesce("_n", F.lit(0))).drop("_n")
    texts = categorical_columns(t)
    if not texts:
        return out.withColumn("sample_values", F.lit(""))
    return out.join(sample_levels(t, texts, samples), "column", "left").withColumn(
        "sample_values", F.coalesce("sample_values", F.lit(""))
    )


def moments(t: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """Count, mean, deviation, range, and bias-corrected skewness and excess kurtosis."""
    cols = list(cols or numeric_columns(t))
    # one small aggregate over (column, value): a wide one over all columns at once is too much
    # code for the compiler of the JVM and several times slower
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("v"))
            for c in cols
        ]
    )
    long = t.select(F.inline(cells)).groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.skewness("v").alias("g"), F.kurtosis("v").alias("k"),
    )
    # a table without rows has all columns still
    names = t.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    long = names.join(long, "column", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    n = F.col("count").cast("double")
    skewness = F.when(n > 2, F.col("g") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurtosis = F.when(
        n > 3, ratio((n - 1) * ((n + 1) * F.col("k") + F.lit(6.0)), (n - 2) * (n - 3))
    )
    rounded = ["mean", "std", "min", "max", "skewness", "kurtosis"]
    return (
        long.withColumns({"skewness": skewness, "kurtosis": kurtosis})
        .drop("g", "k")
        .withColumns({name: round_half_up(name, digits) for name in rounded})
    )


def describe(t: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """The moments, and exact quartiles."""
    cols = list(cols or numeric_columns(t))
    quartiles = percentiles(t, cols, [0.25, 0.5, 0.75])

    def quartile(k: int) -> Column:
        per_column = F.create_map(
            *[x for c in cols for x in (F.lit(c), F.lit(quartiles[c][k]).cast("double"))]
        )
        return round_half_up(per_column[F.col("column")], digits)

    return moments(t, cols, digits).select(
        "column",
        "count",
        "mean",
        "std",
        "min",
        *[quartile(k).alias(name) for k, name in enumerate(["p25", "p50", "p75"])],
        "max",
        "skewness",
        "kurtosis",
    )


def distribution(t: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Rows and percentage per value, most frequent first."""
    counts = t.groupBy(quoted(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percentage", percent("count", total, digits)).orderBy(
        F.col("count").desc(), "value"
    )


def sentinel_counts(t: DataFrame, rules: Mapping[str, Column], digits: int = 2) -> DataFrame:
    """How many rows match each rule, in one pass; long: check, rows, pct."""
    row = t.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_where(p).alias(f"c{i}") for i, p in enumerate(rules.values())],
    )
    long = lengthen(
        row,
        [
            {"check": name, "rows": F.col(f"c{i}"), "total": F.col("total")}
            for i, name in enumerate(rules)
        ],
    )
    return long.withColumn("pct", percent("rows", "total", digits)).drop("total")


def outliers(t: DataFrame, col: str, q: float = 0.99) -> DataFrame:
    """Rows above a percentile of their own column."""
    limit = percentiles(t, [col], [q])[col][0]
    over = count_where(quoted(col) > F.lit(limit).cast("double"))
    return t.agg(F.count(F.lit(1)).alias("total_rows"), over.alias("rows_above")).select(
        F.lit(col).alias("column"),
        F.lit(limit).cast("double").alias("threshold"),
        "total_rows",
        "rows_above",
    )


def duplicate_groups(t: DataFrame, keys: Sequence[str] | Mapping[str, Column] | None = None) -> DataFrame:
    """Key values that occur more than once. Copies collapse before the shuffle."""
    if keys is None or not isinstance(keys, Mapping):
        keys = {k: quoted(k) for k in (keys or t.columns)}
    return (
        t.groupBy(*[c.alias(name) for name, c in keys.items()])
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def duplicate_count(t: DataFrame, keys: Sequence[str] | Mapping[str, Column] | None = None) -> DataFrame:
    """Number of repeated groups and of extra copies in them."""
    return duplicate_groups(t, keys).agg(
        F.count(F.lit(1)).alias("repeated_groups"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_copies"),
    )


@dataclass(frozen=True)
class Check:
    """A line of the quality summary: rows matching ``predicate``.

    ``severity`` is fixed, or ``None`` to grade by share: above 10 % High, above 1 %
    Medium, otherwise Low.
    """

    name: str
    predicate: Column
    recommendation: str
    severity: str | None = None


def quality_summary(t: DataFrame, checks: Sequence[Check], y: str | None = None) -> DataFrame:
    """Missing cells, exact duplicates, the checks, and class imbalance, graded.

    Everything but the duplicates comes from one pass.
    """
    nulls = F.lit(0)
    for c in t.columns:
        nulls = nulls + quoted(c).isNull().cast("int")
    aggregates = [
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("nulls"),
        *[count_where(k.predicate).alias(f"c{i}") for i, k in enumerate(checks)],
    ]
    if y:
        aggregates.append(F.coalesce(F.sum(F.col(y).cast("long")), F.lit(0)).alias("positives"))
    row = t.agg(*aggregates).withColumn(
        "duplicates", duplicate_count(t).select("extra_copies").scalar()
    )

    lines = [
        ("Structural nulls", "nulls", "null cells", "any:High", "Fill or drop missing cells"),
        (
            "Exact duplicate rows",
            "duplicates",
            "duplicates",
            "any:Medium",
            "Inspect and remove true duplicates",
        ),
    ]
    lines += [
        (k.name, f"c{i}", "rows", k.severity or "graded", k.recommendation)
        for i, k in enumerate(checks)
    ]
    if y:
        advice = "Use stratified splits and class weights"
        lines.append(("Class imbalance", "positives", "balance", "High", advice))
    long = lengthen(
        row,
        [
            {
                "check": name,
                "rows": F.col(source).cast("long"),
                "unit": unit,
                "grade": grade,
                "recommendation": advice,
                "total": F.col("total"),
            }
            for name, source, unit, grade, advice in lines
        ],
    )
    long = long.withColumns(
        {
            "pct": F.coalesce(percent("rows", "total"), F.lit(0.0)),
            "negatives": F.col("total") - F.col("rows"),
        }
    ).withColumn("imbalance", round_half_up(ratio("negatives", "rows"), 1))
    finding = (
        F.when(F.col("unit") == "rows", F.format_string("%d rows (%.2f%%)", "rows", "pct"))
        .when(
            F.col("unit") == "balance",
            F.format_string("no=%d yes=%d ratio=%.1f:1", "negatives", "rows", "imbalance"),
        )
        .otherwise(F.format_string("%d %s", "rows", "unit"))
    )
    graded = F.when(F.col("pct") > 10, "High").when(F.col("pct") > 1, "Medium").otherwise("Low")
    severity = (
        F.when(F.col("grade") == "graded", graded)
        .when(~F.col("grade").startswith("any:"), F.col("grade"))
        .when(F.col("rows") > 0, F.substring_index("grade", ":", -1))
        .otherwise("None")
    )
    return long.select(
        "check", "rows", finding.alias("finding"), severity.alias("severity"), "recommendation"
    )


def schema_table(t: DataFrame) -> DataFrame:
    """Names and types of the columns, split into numeric and categorical."""
    rows = []
    for i, f in enumerate(t.schema.fields):
        kind = "numeric" if isinstance(f.dataType, T.NumericType) else "categorical"
        rows.append((i, f.name, f.dataType.simpleString(), kind))
    return t.sparkSession.createDataFrame(
        rows, "position int, column string, dtype string, kind string"
    )
