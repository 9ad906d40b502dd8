"""Conversion rates by dimension, and what is derived from the group rows.

Rows are aggregated first (Spark combines them before the shuffle, so a dimension value
that holds a third of the table is no bottleneck). Ranks, shares and differences are
windows over the group rows only. A running total over a column with many values goes
through ``running_sums``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.functions.columns import (
    count_where,
    ordinal,
    percent,
    ratio,
    round_half_up,
)
from convlens.operators.shape import lengthen
from convlens.operators.slicing import VALUES_PER_SLICE, plan_cuts, running_sums

N, HITS, RATE = "total_clients", "subscribed", "conv_rate_pct"
Dims = Sequence[str] | Mapping[str, Column]


def _named(dims: Dims) -> dict[str, Column]:
    return dict(dims) if isinstance(dims, Mapping) else {d: F.col(d) for d in dims}


def _measures(y: str) -> list[Column]:
    # an empty group cannot occur, an empty table gives 0 rows or a zero total
    return [
        F.count(F.lit(1)).alias(N),
        F.coalesce(F.sum(F.col(y).cast("long")), F.lit(0)).alias(HITS),
    ]


def overview(t: DataFrame, y: str = "y_encoded", by: Sequence[str] = ()) -> DataFrame:
    """Size, positives, negatives, both rates and the number of negatives per positive."""
    a = t.groupBy(*by).agg(*_measures(y))
    return a.select(
        *by,
        F.col(N),
        F.col(HITS).alias("total_subscribed"),
        (F.col(N) - F.col(HITS)).alias("total_not_subscribed"),
        percent(HITS, N).alias("subscription_rate_pct"),
        percent(F.col(N) - F.col(HITS), N).alias("non_subscription_rate_pct"),
        round_half_up(ratio(F.col(N) - F.col(HITS), HITS), 1).alias("imbalance_ratio_no_per_yes"),
    )


def conversion(
    t: DataFrame,
    dims: Dims,
    y: str = "y_encoded",
    extras: Mapping[str, Column] | None = None,
    min_n: int | None = None,
) -> DataFrame:
    """Rows, positives and rate per group, with further aggregates of the caller's choice."""
    named = _named(dims)
    out = t.groupBy(*[c.alias(name) for name, c in named.items()]).agg(
        *_measures(y), *[c.alias(name) for name, c in (extras or {}).items()]
    )
    if min_n is not None:
        out = out.where(F.col(N) >= min_n)
    return out.select(
        *named, N, HITS, percent(HITS, N).alias(RATE), *(extras or {})
    )


def conversion_by_lookup(
    facts: DataFrame, lookup: DataFrame, key: str, dims: Dims, y: str = "y_encoded"
) -> DataFrame:
    """Conversion by attributes kept in another table with one row per ``key``.

    Facts are added up per key before the join, so the join moves one row per key and
    task, and a key with a third of all facts is no larger than any other.
    """
    named = _named(dims)
    per_key = facts.groupBy(key).agg(*_measures(y))
    joined = per_key.join(lookup, key)
    out = joined.groupBy(*[c.alias(name) for name, c in named.items()]).agg(
        F.sum(N).alias(N), F.sum(HITS).alias(HITS)
    )
    return out.withColumn(RATE, percent(HITS, N))


def _finest(t: DataFrame, named: Mapping[str, Column], y: str) -> DataFrame:
    """One row per combination of the dimensions, so that later sets expand few rows."""
    return t.groupBy(*[c.cast("string").alias(name) for name, c in named.items()]).agg(
        *_measures(y)
    )


def multi_conversion(t: DataFrame, dims: Dims, y: str = "y_encoded") -> DataFrame:
    """Conversion by each of several dimensions, stacked long, from one scan of the table."""
    named = _named(dims)
    names = list(named)
    cells = _finest(t, named, y)
    stacked = cells.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.sum(N).alias(N), F.sum(HITS).alias(HITS), *[F.grouping(n).alias(f"_g_{n}") for n in names]
    )
    dimension, category = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n in names:
        kept = F.col(f"_g_{n}") == 0
        dimension = F.when(kept, F.lit(n)).otherwise(dimension)
        category = F.when(kept, F.col(n)).otherwise(category)
    return stacked.select(
        dimension.alias("dimension"),
        category.alias("category"),
        N,
        HITS,
        percent(HITS, N).alias(RATE),
    )


def kpi_cube(t: DataFrame, dims: Dims, y: str = "y_encoded") -> DataFrame:
    """The key figures for every combination of filters on the dimensions.

    ``filter_id`` is the grouping id: a set bit marks a dimension that is not filtered,
    which tells it from a NULL value of the dimension.
    """
    named = _named(dims)
    cells = _finest(t, named, y)
    return (
        cells.cube(*named)
        .agg(
            F.grouping_id().cast("long").alias("filter_id"),
            F.sum(N).alias(N),
            F.sum(HITS).alias(HITS),
        )
        .withColumn(RATE, percent(HITS, N))
    )


def cross_table(
    t: DataFrame, row: str, column: str, levels: Sequence[str], y: str = "y_encoded"
) -> DataFrame:
    """Volume and rate of ``row`` x ``column`` in wide form: ``<level>_n``, ``<level>_rate``."""
    cells = t.groupBy(row, column).agg(*_measures(y))
    return (
        cells.groupBy(row)
        .pivot(column, list(levels))
        .agg(
            F.sum(N).alias("n"),
            percent(F.sum(HITS), F.sum(N)).alias("rate"),
        )
    )


# -- columns derived from the group rows ------------------------------------


def with_rank(
    res: DataFrame, measure: str = RATE, name: str = "rank_by_conv", by: Sequence[str] = ()
) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(measure).desc())
    return res.withColumn(name, F.rank().over(w).cast("long"))


def with_percent_rank(
    res: DataFrame,
    measure: str = RATE,
    name: str = "conv_percent_rank",
    by: Sequence[str] = (),
    digits: int = 1,
) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(measure))
    ranked = res.withColumn("_rank", F.percent_rank().over(w))
    return ranked.withColumn(name, round_half_up(F.lit(100.0) * F.col("_rank"), digits)).drop(
        "_rank"
    )


def with_share(
    res: DataFrame,
    measure: str = N,
    name: str = "pct_of_dataset",
    by: Sequence[str] = (),
    digits: int = 2,
) -> DataFrame:
    whole = res.withColumn("_all", F.sum(measure).over(Window.partitionBy(*by)))
    return whole.withColumn(name, percent(measure, "_all", digits)).drop("_all")


def vs_mean(
    res: DataFrame, kind: str, measure: str = RATE, name: str | None = None, digits: int = 2
) -> DataFrame:
    """Difference to (``diff``) or quotient by (``index``) the unweighted mean of the groups."""
    if kind not in ("diff", "index"):
        raise ValueError(f"kind must be diff or index, not {kind}")
    mean = F.col("_mean")
    if kind == "diff":
        name, value = name or "diff_from_mean_pp", F.col(measure) - mean
    else:
        name, value = name or "conv_index", ratio(measure, mean)
    with_mean = res.withColumn("_mean", F.avg(measure).over(Window.partitionBy()))
    return with_mean.withColumn(name, round_half_up(value, digits)).drop("_mean")


def with_reach(
    res: DataFrame,
    order: str,
    measure: str = N,
    name: str = "pct_clients_reached_by_this_count",
    digits: int = 1,
    values_per_slice: int = VALUES_PER_SLICE,
) -> DataFrame:
    """Running share of the total up to and including each value of ``order``."""
    cuts = plan_cuts(res, order, values_per_slice)
    run = running_sums(res, [], order, {"_reached": measure}, cuts, totals={"_all": measure})
    return run.withColumn(name, percent("_reached", "_all", digits)).drop("_reached", "_all")


def order_levels(res: DataFrame, col: str, levels: Sequence[str], name: str = "position") -> DataFrame:
    """Put groups in a given order; groups outside the list are left out."""
    return (
        res.withColumn(name, ordinal(col, levels))
        .where(F.col(name).isNotNull())
        .orderBy(name)
    )


def extremes(
    res: DataFrame, key: str, measure: str = RATE, by: Sequence[str] = ()
) -> DataFrame:
    """Best and worst group; equal rates go to the smaller key."""
    high = F.struct(-F.col(measure), F.col(key))
    low = F.struct(F.col(measure), F.col(key))
    return res.groupBy(*by).agg(
        F.min_by(key, high).alias("best"),
        F.max(measure).alias("best_rate"),
        F.min_by(key, low).alias("worst"),
        F.min(measure).alias("worst_rate"),
    )


def top_bottom(res: DataFrame, key: str, k: int = 3, measure: str = RATE) -> DataFrame:
    """The k groups with the highest and the k with the lowest rate."""
    top = res.orderBy(F.col(measure).desc(), key).limit(k).withColumn("end", F.lit("top"))
    bottom = res.orderBy(F.col(measure).asc(), key).limit(k).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)


def subset_rates(
    t: DataFrame, subsets: Mapping[str, Column], y: str = "y_encoded", digits: int = 2
) -> DataFrame:
    """Size and rate of several, possibly overlapping, subsets in one pass; long form."""
    names = list(subsets)
    row = t.agg(
        *[count_where(p).alias(f"n{i}") for i, p in enumerate(subsets.values())],
        *[
            count_where(p & (F.col(y) == 1)).alias(f"h{i}")
            for i, p in enumerate(subsets.values())
        ],
    )
    long = lengthen(
        row,
        [
            {"subset": name, N: F.col(f"n{i}"), HITS: F.col(f"h{i}")}
            for i, name in enumerate(names)
        ],
    )
    return long.withColumn(RATE, percent(HITS, N, digits))


def stack_results(*results: DataFrame) -> DataFrame:
    """UNION ALL of results of the same shape."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def profile_by_outcome(
    t: DataFrame,
    by: str,
    col: str,
    averages: Mapping[str, str] | None = None,
) -> DataFrame:
    """Count, mean, minimum and maximum of a column per outcome, and means of other columns."""
    return t.groupBy(F.col(by).alias("outcome")).agg(
        F.count(F.lit(1)).alias("clients"),
        round_half_up(F.avg(col), 0).alias("avg_duration_sec"),
        round_half_up(F.avg(col) / F.lit(60.0), 1).alias("avg_duration_min"),
        F.min(col).alias("min_sec"),
        F.max(col).alias("max_sec"),
        *[round_half_up(F.avg(c), 2).alias(name) for name, c in (averages or {}).items()],
    )


def rollup_kpis(t: DataFrame, averages: Mapping[str, tuple[str, int]], y: str = "y_encoded") -> DataFrame:
    """The headline figures; means come from sums and counts, divided once."""
    a = t.agg(
        *_measures(y),
        *[F.sum(c).alias(f"_s_{name}") for name, (c, _) in averages.items()],
        *[F.count(c).alias(f"_n_{name}") for name, (c, _) in averages.items()],
    )
    return a.select(
        N,
        F.col(HITS).alias("total_subscribed"),
        (F.col(N) - F.col(HITS)).alias("total_not_subscribed"),
        percent(HITS, N).alias("subscription_rate"),
        round_half_up(ratio(F.col(N) - F.col(HITS), HITS), 1).alias("imbalance_ratio"),
        *[
            round_half_up(ratio(f"_s_{name}", f"_n_{name}"), digits).alias(name)
            for name, (_, digits) in averages.items()
        ],
    )

