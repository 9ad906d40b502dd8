"""Exact percentiles and medians without a global sort.

A column of few values is counted by value. For others a sketch brackets each wanted rank
between two values; only rows inside the bracket are then grouped and counted, everything
below is a plain conditional count. The answer is exact: the bracket is checked against the
true ranks, and widened to the whole column if the sketch missed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions.columns import count_where, quoted, round_half_up
from convlens.operators.slicing import (
    VALUES_PER_SLICE,
    plan_cuts,
    running_sums,
    sketch_error,
    sketched_quantiles,
)

# The bracket reaches two rank errors of the sketch to either side.
MARGIN = 2 * sketch_error()
# Up to so many distinct values are counted one by one.
FEW = 100_000


@dataclass
class _Wanted:
    column: str
    prob: float
    low_rank: int
    high_rank: int
    fraction: float
    low: float
    high: float


def _value(col: str):
    """A column as double, NaN treated as missing."""
    v = quoted(col).cast("double")
    return F.when(~F.isnan(v), v)


def percentiles(
    t: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    values_per_slice: int = VALUES_PER_SLICE,
) -> dict[str, list[float | None]]:
    """Percentiles with linear interpolation, for all columns in the same passes.

    Returns ``len(cols) * len(probs)`` numbers to the driver. Columns of few values are read
    twice (distinct count, counts by value), others three times more (sketch, counts, values
    inside the brackets), and nothing is shuffled but counted values.
    """
    names = [f"v{i}" for i in range(len(cols))]
    values = t.select(*[_value(c).alias(n) for c, n in zip(cols, names)])
    head = values.agg(
        *[F.count(n).alias(f"n_{n}") for n in names],
        *[F.approx_count_distinct(n).alias(f"d_{n}") for n in names],
    ).first()
    few = [n for n in names if 0 < head[f"d_{n}"] <= FEW]
    many = [n for n in names if head[f"d_{n}"] > FEW]
    edges = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-MARGIN, MARGIN)})
    sketch = sketched_quantiles(values, {n: F.col(n) for n in many}, edges) if many else {}

    def wanted(n: str, p: float) -> _Wanted:
        position = p * (head[f"n_{n}"] - 1)
        low, high = max(0.0, p - MARGIN), min(1.0, p + MARGIN)
        at = dict(zip(edges, sketch.get(n, [])))
        whole = n not in sketch
        return _Wanted(
            n,
            p,
            math.floor(position),
            math.ceil(position),
            position - math.floor(position),
            -math.inf if low == 0.0 or whole else at[low],
            math.inf if high == 1.0 or whole else at[high],
        )

    found = _counted(values, [wanted(n, p) for n in few for p in probs], values_per_slice)
    bracketed = [wanted(n, p) for n in many for p in probs]
    found.update(_select(values, bracketed, values_per_slice))
    missed = [w for w in bracketed if (w.column, w.prob) not in found]
    if missed:
        for w in missed:
            w.low, w.high = -math.inf, math.inf
        found.update(_select(values, missed, values_per_slice))
    return {
        c: [found.get((n, p)) for p in probs] for c, n in zip(cols, names)
    }


def bin_limits(
    t: DataFrame, cols: Sequence[str], bins: int, values_per_slice: int = VALUES_PER_SLICE
) -> dict[str, list[float]]:
    """Per column the upper limits of all bins but the last: the distinct values at the ranks ``i * n // bins`` of its n
    sorted values, or, if it has at most ``bins`` distinct values, all of them but the largest.

    Read in the same passes as ``percentiles``; at most ``bins`` numbers a column come to the driver.
    """
    largest = 1.7976931348623157e308  # stands for infinity, which has no place between two numbers
    names = [f"v{i}" for i in range(len(cols))]
    finite = {n: F.when(_value(c) > largest, largest).when(_value(c) < -largest, -largest).otherwise(_value(c)) for c, n in zip(cols, names)}
    values = t.select(*[v.alias(n) for n, v in finite.items()])
    head = values.agg(
        *[F.count(n).alias(f"n_{n}") for n in names],
        *[F.approx_count_distinct(n).alias(f"d_{n}") for n in names],
    ).first()
    few = [n for n in names if 0 < head[f"d_{n}"] <= FEW]
    many = [n for n in names if head[f"d_{n}"] > FEW]
    out: dict[str, list[float]] = {}
    if few:
        cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in few])
        each = values.select(F.inline(cells)).where("v is not null").distinct()
        listed = F.when(F.count("v") <= bins, F.sort_array(F.collect_list("v"))).alias("own")
        out = {r["name"]: r["own"][:-1] for r in each.groupBy("name").agg(listed).where("own is not null").collect()}
    ranked = [n for n in few if n not in out]
    probs = [i / bins for i in range(1, bins)]
    edges = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-MARGIN, MARGIN)})
    sketch = sketched_quantiles(values, {n: F.col(n) for n in many}, edges) if many else {}

    def wanted(n: str, i: int) -> _Wanted:
        rank, at = (i + 1) * head[f"n_{n}"] // bins, dict(zip(edges, sketch.get(n, [])))
        low, high = max(0.0, probs[i] - MARGIN), min(1.0, probs[i] + MARGIN)
        return _Wanted(n, probs[i], rank, rank, 0.0, at.get(low, -math.inf) if low > 0.0 else -math.inf, at.get(high, math.inf) if high < 1.0 else math.inf)

    found = _counted(values, [wanted(n, i) for n in ranked for i in range(bins - 1)], values_per_slice)
    bracketed = [wanted(n, i) for n in many for i in range(bins - 1)]
    found.update(_select(values, bracketed, values_per_slice))
    missed = [w for w in bracketed if (w.column, w.prob) not in found]
    for w in missed:
        w.low, w.high = -math.inf, math.inf
    found.update(_select(values, missed, values_per_slice))
    out |= {n: sorted({found[n, p] for p in probs}) for n in [*ranked, *many]}
    return {c: out.get(n, []) for c, n in zip(cols, names)}


def _counted(
    values: DataFrame, wanted: Sequence[_Wanted], values_per_slice: int
) -> dict[tuple[str, float], float]:
    """Order statistics of columns of few values, from the counts of all their values."""
    if not wanted:
        return {}
    names = list(dict.fromkeys(w.column for w in wanted))
    cells = F.array(*[F.struct(F.lit(i).alias("id"), F.col(n).alias("v")) for i, n in enumerate(names)])
    counts = values.select(F.inline(cells)).where("v is not null").groupBy("id", "v").agg(F.count(F.lit(1)).alias("rows"))
    cuts = plan_cuts(counts, "v", values_per_slice) if len(names) * FEW > values_per_slice else []
    ranked = running_sums(counts, ["id"], "v", {"upto": "rows"}, cuts)

    def at(w: _Wanted, rank: int):
        return F.min(F.when((F.col("id") == names.index(w.column)) & (F.col("upto") > rank), F.col("v")))

    row = ranked.agg(
        *[at(w, w.low_rank).alias(f"l{i}") for i, w in enumerate(wanted)],
        *[at(w, w.high_rank).alias(f"h{i}") for i, w in enumerate(wanted)],
    ).first()
    return {(w.column, w.prob): row[f"l{i}"] + (row[f"h{i}"] - row[f"l{i}"]) * w.fraction for i, w in enumerate(wanted)}


def order_statistic(
    t: DataFrame,
    col: str,
    rank: int,
    rows: int | None = None,
    values_per_slice: int = VALUES_PER_SLICE,
) -> float | None:
    """The value at a zero-based rank of the sorted column, None beyond its end.

    ``rows`` is the number of values, where the caller knows it already.
    """
    values = t.select(_value(col).alias("v0"))
    if rows is None:
        rows = values.agg(F.count("v0")).first()[0]
    if not 0 <= rank < rows:
        return None
    share = rank / rows
    edges = sketched_quantiles(values, {"v0": F.col("v0")}, [max(0.0, share - MARGIN), min(1.0, share + MARGIN)])["v0"]
    low = -math.inf if share <= MARGIN else edges[0]
    high = math.inf if share >= 1.0 - MARGIN else edges[1]
    wanted = _Wanted("v0", 0.0, rank, rank, 0.0, low, high)
    found = _select(values, [wanted], values_per_slice)
    if not found:
        wanted.low, wanted.high = -math.inf, math.inf
        found = _select(values, [wanted], values_per_slice)
    return found["v0", 0.0]


def _select(
    values: DataFrame, wanted: Sequence[_Wanted], values_per_slice: int
) -> dict[tuple[str, float], float]:
    """Order statistics at the wanted ranks; those outside their bracket are left out."""
    if not wanted:
        return {}
    v, low, high = "v", "low", "high"
    below_in = [
        (F.col(w.column) < F.lit(w.low), F.col(w.column).between(F.lit(w.low), F.lit(w.high)))
        for w in wanted
    ]
    sizes = values.agg(
        *[count_where(b).alias(f"b{i}") for i, (b, _) in enumerate(below_in)],
        *[count_where(inside).alias(f"i{i}") for i, (_, inside) in enumerate(below_in)],
    ).first()
    below = [sizes[f"b{i}"] for i in range(len(wanted))]
    rows_inside = [sizes[f"i{i}"] for i in range(len(wanted))]

    any_inside = F.lit(False)
    for _, inside in below_in:
        any_inside = any_inside | inside
    entries = F.array(
        *[
            F.when(inside, F.struct(F.lit(i).alias("id"), F.col(w.column).alias(v)))
            for i, (w, (_, inside)) in enumerate(zip(wanted, below_in))
        ]
    )
    counts = (
        values.where(any_inside)
        .select(F.explode(F.array_compact(entries)).alias("e"))
        .groupBy("e.id", f"e.{v}")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    cuts = plan_cuts(counts, v, values_per_slice) if max(rows_inside) > values_per_slice else []
    ranked = running_sums(counts, ["id"], v, {"upto": "rows"}, cuts)

    def at_rank(ranks: list[int]):
        by_id = F.array(*[F.lit(r) for r in ranks])
        return F.min(F.when(F.col("upto") > by_id[F.col("id")], F.col(v)))

    picked = ranked.groupBy("id").agg(
        at_rank([w.low_rank - b for w, b in zip(wanted, below)]).alias(low),
        at_rank([w.high_rank - b for w, b in zip(wanted, below)]).alias(high),
    )
    found = {}
    for row in picked.collect():  # one row per wanted percentile
        i = row["id"]
        w = wanted[i]
        if w.low_rank < below[i] or w.high_rank - below[i] >= rows_inside[i]:
            continue
        found[(w.column, w.prob)] = row[low] + (row[high] - row[low]) * w.fraction
    return found


def value_counts(t: DataFrame, by: Sequence[str], col: str, name: str = "value") -> DataFrame:
    """Rows per distinct value of ``col`` in each group; missing values are left out."""
    return (
        t.select(*by, _value(col).alias(name))
        .where(F.col(name).isNotNull())
        .groupBy(*by, name)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def ranked_values(
    t: DataFrame, by: Sequence[str], col: str, values_per_slice: int = VALUES_PER_SLICE
) -> DataFrame:
    """Distinct values with the range of ranks they hold: ``upto - rows + 1 .. upto`` of ``n``."""
    cuts = plan_cuts(t, col, values_per_slice)
    counts = value_counts(t, by, col)
    return running_sums(counts, by, "value", {"upto": "rows"}, cuts, totals={"n": "rows"})


def median_by(
    t: DataFrame, by: Sequence[str], col: str, values_per_slice: int = VALUES_PER_SLICE
) -> DataFrame:
    """Exact median per group: the mean of the middle value, or of the two middle values."""
    ranked = ranked_values(t, by, col, values_per_slice)
    low = F.floor((F.col("n") + 1) / F.lit(2.0))
    high = F.ceil((F.col("n") + 1) / F.lit(2.0))
    return (
        ranked.groupBy(*by)
        .agg(
            F.max("n").alias("clients"),
            F.min(F.when(F.col("upto") >= low, F.col("value"))).alias("_low"),
            F.min(F.when(F.col("upto") >= high, F.col("value"))).alias("_high"),
        )
        .withColumn("median", (F.col("_low") + F.col("_high")) / F.lit(2.0))
        .drop("_low", "_high")
    )


def approx_median(
    t: DataFrame,
    by: Sequence[str],
    col: str,
    low: float = 0.49,
    high: float = 0.51,
    digits: int = 0,
    values_per_slice: int = VALUES_PER_SLICE,
) -> DataFrame:
    """Mean of the values whose fractional rank lies in ``[low, high]``, per group.

    A value shared by many rows counts once for each of its ranks inside the range.
    A group too small to have a rank in the range gives NULL.
    """
    ranked = ranked_values(t, by, col, values_per_slice)
    # ranks r with low <= r / n <= high; the small slack keeps exact bounds inside
    first = F.greatest(
        F.col("upto") - F.col("rows") + 1, F.ceil(F.lit(low) * F.col("n") - F.lit(1e-9))
    )
    last = F.least(F.col("upto"), F.floor(F.lit(high) * F.col("n") + F.lit(1e-9)))
    inside = F.greatest(last - first + 1, F.lit(0))
    return (
        ranked.withColumn("_inside", inside)
        .groupBy(*by)
        .agg(
            F.max("n").alias("clients"),
            round_half_up(
                F.sum(F.col("value") * F.col("_inside"))
                / F.nullif(F.sum("_inside"), F.lit(0)).cast("double"),
                digits,
            ).alias("approx_median"),
        )
    )
