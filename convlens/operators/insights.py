"""Findings, insights, facts, the result bundle, and reconciliation of figures.

Every number is computed from result tables; no text is written ahead of the data.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.columns import finite_or_null, quoted, ratio, round_half_up
from convlens.operators.conversion import HITS, N, RATE, extremes
from convlens.sources.staging import stage


# -- facts ------------------------------------------------------------------


def facts(results: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """All results as one long table: section, key, metric, value.

    ``results`` maps a section to a result and its key column (an expression). Every
    numeric column of the result becomes a metric.
    """
    out = None
    for section, (res, key) in results.items():
        metrics = [
            f.name for f in res.schema.fields if isinstance(f.dataType, T.NumericType)
        ]
        entries = F.array(
            *[
                F.struct(F.lit(m).alias("metric"), quoted(m).cast("double").alias("value"))
                for m in metrics
            ]
        )
        long = res.select(
            F.lit(section).alias("section"), F.expr(key).cast("string").alias("key"),
            F.explode(entries).alias("e"),
        ).select("section", "key", "e.*")
        out = long if out is None else out.unionByName(long)
    return out


# -- findings and insights ----------------------------------------------------


def finding(question: str, evidence: DataFrame) -> DataFrame:
    """Attach a question to a one-column table of computed evidence."""
    return evidence.select(F.lit(question).alias("question"), F.col(evidence.columns[0]).alias("evidence"))


def extremes_text(res: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """``Highest: a (x%), lowest: b (y%)`` of a conversion result."""
    spec = f"%.{digits}f%%"
    return extremes(res, key).select(
        F.format_string(
            f"Highest: %s ({spec}), lowest: %s ({spec})",
            "best",
            round_half_up("best_rate", digits),
            "worst",
            round_half_up("worst_rate", digits),
        ).alias("evidence")
    )


def insights(multi: DataFrame, overall: DataFrame) -> DataFrame:
    """Per dimension: best and worst group, their rates, and the lift over the whole table, with a
    headline, a detail and the evidence in words.

    ``multi`` is a ``multi_conversion`` result, ``overall`` an ``overview`` of the table.
    """
    base = overall.select("subscription_rate_pct").scalar()
    best = extremes(multi, "category", by=["dimension"])
    lift = lambda rate: round_half_up(ratio(rate, "base_rate"), 2)
    out = best.withColumn("base_rate", base)
    return out.select(
        "dimension",
        "best",
        "best_rate",
        lift("best_rate").alias("best_lift"),
        "worst",
        "worst_rate",
        lift("worst_rate").alias("worst_lift"),
        "base_rate",
        F.format_string(
            "%s: %s converts at %.1f%%, %.1fx the overall %.1f%%",
            "dimension",
            "best",
            round_half_up("best_rate", 1),
            round_half_up(lift("best_rate"), 1),
            round_half_up("base_rate", 1),
        ).alias("headline"),
        F.format_string(
            "Lowest is %s at %.1f%%, %.1fx the overall rate",
            "worst",
            round_half_up("worst_rate", 1),
            round_half_up(lift("worst_rate"), 1),
        ).alias("detail"),
        F.format_string(
            "%s %.2f%% against %s %.2f%%", "best", "best_rate", "worst", "worst_rate"
        ).alias("evidence"),
    )


def tier_summary(res: DataFrame, tier_col: str) -> DataFrame:
    """Group rows rolled up into tiers: groups, size and rate from sums, never from rates."""
    return (
        res.groupBy(tier_col)
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum(N).alias(N),
            F.sum(HITS).alias(HITS),
        )
        .withColumn(RATE, round_half_up(F.lit(100.0) * ratio(HITS, N), 2))
    )


# -- bundle -----------------------------------------------------------------


def _clean(field: T.StructField) -> Column:
    c = quoted(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = finite_or_null(c)
    return c.alias(field.name)


def bundle(results: Mapping[str, DataFrame]) -> DataFrame:
    """Sections as rows of JSON records: section, record. NaN and infinities become null.

    This form has no size limit; written as JSON lines it is the bundle of large results.
    """
    out = None
    for section, res in results.items():
        record = F.struct(*[_clean(f) for f in res.schema.fields])
        rows = res.select(
            F.lit(section).alias("section"),
            F.to_json(record, {"ignoreNullFields": "false"}).alias("record"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def document_lines(results: Mapping[str, DataFrame]) -> DataFrame:
    """One JSON document of any size as numbered lines: an array of records per section.

    Sections keep their order, also those without records; records are in order of their text. The
    lines in order of ``position`` are the document. No section is gathered anywhere: records are
    range-sorted, and a comma is put before all but the first one of a section.
    """
    names = list(results)
    spark = next(iter(results.values())).sparkSession
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rows = bundle(results).select(place[F.col("section")].alias("at"), "record")
    ranged = rows.repartitionByRange("at", "record").sortWithinPartitions("at", "record")
    ranged = stage(ranged.withColumn("nr", F.monotonically_increasing_id()), "bundle-records")
    first = ranged.groupBy("at").agg(F.min("nr").alias("first"))  # one row a section
    comma = F.when(F.col("nr") == F.col("first"), "").otherwise(",")
    records = ranged.join(first, "at").select("at", F.lit(1).alias("part"), "nr", F.concat(comma, "record").alias("line"))
    frame = []
    for i, n in enumerate(names):
        frame.append((i, 0, 0, ("{" if i == 0 else ",") + json.dumps(n) + ":["))
        frame.append((i, 2, 0, "]}" if i == len(names) - 1 else "]"))
    frame = spark.createDataFrame(frame, "at int, part int, nr long, line string")
    # sections, then head, records and end; nr is below 2 ** 57
    position = (F.col("at").cast("decimal(38,0)") * 3 + F.col("part")) * F.lit(1 << 57).cast("decimal(38,0)") + F.col("nr")
    return records.unionByName(frame).select(position.cast("decimal(38,0)").alias("position"), "line")


def write_document(results: Mapping[str, DataFrame], path: str) -> None:
    """Write the document as text files whose lines, in order of the file names, are the document."""
    document_lines(results).orderBy("position").select("line").write.mode("overwrite").text(path)


# -- reconciliation -----------------------------------------------------------


def reconcile(
    a: DataFrame,
    b: DataFrame,
    tolerance: float = 0.01,
    tolerances: Mapping[str, float] | None = None,
) -> DataFrame:
    """Compare two computations of the same figures by name (columns ``check``, ``value``).

    ``tolerances`` holds those of single checks; 0 asks for equal values.
    """
    left = a.select("check", F.col("value").cast("double").alias("value_a"))
    right = b.select("check", F.col("value").cast("double").alias("value_b"))
    allowed = F.lit(float(tolerance))
    for name, value in (tolerances or {}).items():
        allowed = F.when(F.col("check") == name, F.lit(float(value))).otherwise(allowed)
    gap = F.abs(F.col("value_a") - F.col("value_b"))
    close = (gap == 0) | (gap < allowed)
    passed = F.coalesce(close, F.lit(False))
    return left.join(right, "check", "full_outer").withColumn(
        "passed", F.when(passed, "PASS").otherwise("FAIL")
    )
