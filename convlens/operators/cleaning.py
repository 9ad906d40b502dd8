"""Rule-based cleaning with an audit trail.

A cleaning run is a list of rules. De-duplication is the only step that shuffles whole
rows; its result is staged once on the shared folder, and the audit, the statistics and
the cleaned table all read from there. Audit figures are plain counts, which stay right
when tasks are run again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.functions.columns import (
    cap,
    count_where,
    flag,
    norm_text,
    number,
    quoted,
    sentinel_flag,
)
from convlens.operators.percentiles import percentiles
from convlens.operators.profiling import duplicate_count
from convlens.operators.shape import lengthen
from convlens.sources.staging import stage
from convlens.sources.tables import rename_columns


@dataclass(frozen=True)
class Rule:
    """One step: at most one of ``dedup``, ``keep``, ``change`` and ``fit`` does the work.

    ``keep`` removes the rows for which it is not true. ``change`` maps a table to one
    with the same rows. ``fit`` measures the table first and returns such a map, with a
    note for the audit. A rule with none of them only documents a decision.
    """

    rule: str
    decision: str
    columns: str
    notes: str = ""
    dedup: bool = False
    keep: Column | None = None
    change: Callable[[DataFrame], DataFrame] | None = None
    fit: Callable[[DataFrame], tuple[Callable[[DataFrame], DataFrame], str]] | None = None


def clean(
    t: DataFrame, rules: Sequence[Rule], first_step: int = 2, staged: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Apply the rules in order; returns the cleaned table and the audit table."""
    table = t  # rows removed as the rules say
    marked = t  # the same rows since the last dedup, with one flag per keep rule
    flags: list[str] = []
    blanked = 0  # flags whose removed rows hold no values any more
    segments: list[tuple[DataFrame, list[str]]] = []
    trail: list[tuple[Rule, str, tuple[int, int]]] = []

    def counter() -> tuple[int, int]:
        return len(segments), len(flags)

    for rule in rules:
        note = rule.notes
        if rule.dedup:
            before = counter()
            segments.append((marked, flags))
            table = table.dropDuplicates()
            if staged:
                table = stage(table, "deduplicated")
            marked, flags, blanked = table, [], 0
            trail.append((rule, note, before))
            continue
        before = counter()
        if rule.keep is not None:
            name = f"_kept_{len(segments)}_{len(flags)}"
            previous = F.col(flags[-1]) if flags else F.lit(True)
            marked = marked.withColumn(
                name, previous & F.coalesce(rule.keep, F.lit(False))
            )
            flags = [*flags, name]
            table = table.where(rule.keep)
        elif rule.change or rule.fit:
            change = rule.change
            if rule.fit:
                change, note = rule.fit(table)
            if len(flags) > blanked:
                marked, blanked = _without_values(marked, flags), len(flags)
            table, marked = change(table), change(marked)
        trail.append((rule, note, before))
    segments.append((marked, flags))
    return table, _audit(t, segments, trail, first_step)


def _without_values(marked: DataFrame, flags: list[str]) -> DataFrame:
    """Rows that a rule has removed are only counted on; a change must not trip over their values."""
    kept = F.col(flags[-1])
    return marked.select(
        *[c if c in flags else F.when(kept, quoted(c)).alias(c) for c in marked.columns]
    )


def _audit(t, segments, trail, first_step) -> DataFrame:
    """One row per rule. Each stretch between two dedups is counted by one aggregate."""
    counts = [
        frame.agg(
            F.array(F.count(F.lit(1)), *[count_where(F.col(f)) for f in flags]).alias("c")
        ).scalar()
        for frame, flags in segments
    ]
    one = t.sparkSession.range(1).select(
        *[c.alias(f"_c{i}") for i, c in enumerate(counts)]
    )

    def rows(at: tuple[int, int]) -> Column:
        return F.col(f"_c{at[0]}")[at[1]]

    after = [at for _, _, at in trail[1:]] + [(len(segments) - 1, len(segments[-1][1]))]
    return lengthen(
        one,
        [
            {
                "step": first_step + i,
                "rule": rule.rule,
                "decision": rule.decision,
                "rows_before": rows(before),
                "rows_after": rows(then),
                "rows_removed": rows(before) - rows(then),
                "cols_affected": rule.columns,
                "notes": note,
            }
            for i, ((rule, note, before), then) in enumerate(zip(trail, after))
        ],
    )


# -- rules ------------------------------------------------------------------


def drop_exact_duplicates() -> Rule:
    return Rule("Remove exact duplicates", "Keep one copy of each row", "all", dedup=True)


def keep_rows(name: str, predicate: Column, columns: str, notes: str = "") -> Rule:
    return Rule(name, "Remove the other rows", columns, notes, keep=predicate)


def standardise(
    y: str | None = None, positive: str = "yes", numeric: Mapping[str, str] | None = None
) -> Rule:
    """Strip and lower-case text, cast numbers strictly, add the 0/1 label ``y_encoded``."""

    def change(t: DataFrame) -> DataFrame:
        return standardise_columns(t, y, positive, numeric)

    return Rule(
        "Standardise types and text",
        "Strip and lower-case text; cast numbers; encode the label",
        "text columns, " + ", ".join([*(numeric or {}), *(["y_encoded"] if y else [])]),
        change=change,
    )


def standardise_columns(
    t: DataFrame,
    y: str | None = None,
    positive: str = "yes",
    numeric: Mapping[str, str] | None = None,
) -> DataFrame:
    numeric = numeric or {}
    texts = {f.name for f in t.schema.fields if f.dataType.simpleString() == "string"}
    out = []
    for c in t.columns:
        v = quoted(c)
        if c in numeric:
            v = number(v, numeric[c])
        elif c in texts:
            v = norm_text(v)
        out.append(v.alias(c))
    t = t.select(*out)
    return t.withColumn("y_encoded", flag(F.col(y) == positive)) if y else t


def keep_label(columns: Sequence[str], label: str = "unknown") -> Rule:
    """Document that a label standing for missing values stays a category of its own."""
    return Rule(
        f"Retain '{label}' in {', '.join(columns)}",
        "Keep as a category",
        ", ".join(columns),
        "No imputation",
    )


def add_sentinel_flag(col: str, sentinel, name: str) -> Rule:
    return Rule(
        f"Flag {name}",
        f"1 where {col} != {sentinel}",
        f"{col} (new: {name})",
        change=lambda t: t.withColumn(name, sentinel_flag(quoted(col), sentinel)),
    )


def winsorise(col: str, q: float = 0.99) -> Rule:
    """Clip at the percentile, truncated to a whole number; the cap goes into the audit."""

    def fit(t: DataFrame):
        limit = percentile_cap(t, col, q)
        if limit is None:
            return lambda x: x, "no values"
        kind = t.schema[col].dataType
        changed = t.where(quoted(col) > limit).count()
        return (
            lambda x: x.withColumn(col, cap(quoted(col), limit).cast(kind)),
            f"cap {limit}: {changed} values capped",
        )

    return Rule(f"Cap {col} at percentile {q:g}", "Winsorise", col, fit=fit)


def percentile_cap(t: DataFrame, col: str, q: float) -> int | None:
    value = percentiles(t, [col], [q])[col][0]
    return None if value is None else int(value)


def rename(names: Mapping[str, str]) -> Rule:
    return Rule(
        "Rename columns",
        ", ".join(f"{a}->{b}" for a, b in names.items()),
        ", ".join(names),
        "Names only",
        change=lambda t: rename_columns(t, names),
    )


# -- validation ---------------------------------------------------------------


def validate_ranges(t: DataFrame, rules: Mapping[str, tuple[str, float | None, float | None]]) -> DataFrame:
    """Count the values outside their range, without removing any; one pass, long form."""

    def outside(col, low, high):
        bad = F.lit(False)
        if low is not None:
            bad = bad | (quoted(col) < low)
        if high is not None:
            bad = bad | (quoted(col) > high)
        return bad

    row = t.agg(*[count_where(outside(*r)).alias(f"c{i}") for i, r in enumerate(rules.values())])
    long = lengthen(
        row,
        [{"check": name, "rows_outside": F.col(f"c{i}")} for i, name in enumerate(rules)],
    )
    return long.withColumn("valid", F.col("rows_outside") == 0)


def assert_domain(t: DataFrame, col: str, allowed: Sequence) -> DataFrame:
    """Stop when a column leaves its domain; NULL is outside.

    The message says how many values and rows are wrong; ``domain_violations`` lists them all.
    """
    bad = domain_violations(t, col, allowed)
    total = bad.agg(F.count(F.lit(1)).alias("values"), F.sum("rows").alias("rows"), F.min("value").alias("one")).first()
    if total["values"]:
        raise ValueError(
            f"unexpected values in {col}: {total['values']} in {total['rows']} rows, such as {total['one']}"
        )
    return t


def domain_violations(t: DataFrame, col: str, allowed: Sequence) -> DataFrame:
    """Every value outside the domain, NULL among them, with its number of rows."""
    v = quoted(col)
    outside = t.where(v.isNull() | ~v.isin(list(allowed)))
    return outside.groupBy(v.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def assert_all(t: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Stop and name every check that some row breaks. One pass for all checks."""
    row = t.agg(
        *[
            count_where(~F.coalesce(ok, F.lit(False))).alias(f"c{i}")
            for i, ok in enumerate(checks.values())
        ]
    ).first()
    broken = [f"{name} ({n} rows)" for name, n in zip(checks, row) if n]
    if broken:
        raise ValueError("failed checks: " + "; ".join(broken))
    return t


def no_nulls(t: DataFrame) -> dict[str, Column]:
    """Checks for ``assert_all``: no column holds a NULL."""
    return {f"{c} is not null": quoted(c).isNotNull() for c in t.columns}


def dedup(t: DataFrame, keys: Sequence[str] | None = None, order: Sequence[Column | str] = ()) -> DataFrame:
    """One row per key: any copy of identical rows, or the first in ``order``.

    With keys, ``row_number() = 1`` is also applied to each partition before the shuffle,
    so a key that holds a third of the table sends one row per partition.
    """
    if keys is None:
        return t.dropDuplicates()
    # the other columns settle ties, so that a rerun keeps the same row
    rest = [quoted(c) for c in t.columns if c not in set(keys)]
    w = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*([*order, *rest] or [F.lit(1)]))
    return t.withColumn("_nr", F.row_number().over(w)).where(F.col("_nr") == 1).drop("_nr")


def clean_report(
    raw: DataFrame, cleaned: DataFrame, y: str, unknown_in: Sequence[str] = (), unknown: str = "unknown"
) -> DataFrame:
    """Rows, columns, null cells, duplicates, label counts and unknown labels, before and after."""

    def side(t: DataFrame, name: str) -> DataFrame:
        nulls = F.lit(0)
        for c in t.columns:
            nulls = nulls + quoted(c).isNull().cast("int")
        figures = {
            "rows": F.count(F.lit(1)),
            "columns": F.lit(len(t.columns)).cast("long"),
            "null cells": F.coalesce(F.sum(nulls).cast("long"), F.lit(0)),
            "label yes": count_where(quoted(y) == "yes"),
            "label no": count_where(quoted(y) == "no"),
        }
        for c in unknown_in:
            figures[f"unknown in {c}"] = count_where(quoted(c) == unknown)
        row = t.agg(*[c.alias(f"f{i}") for i, c in enumerate(figures.values())])
        row = row.withColumn(
            f"f{len(figures)}", duplicate_count(t).select("extra_copies").scalar()
        )
        names = [*figures, "exact duplicates"]
        return lengthen(
            row, [{"measure": m, name: F.col(f"f{i}")} for i, m in enumerate(names)]
        )

    return side(raw, "before").join(side(cleaned, "after"), "measure", "full_outer")

