"""Running totals and ordered lookups that never put a whole table into one task.

``OVER (ORDER BY x)`` sends every row to one task. The operators here cut the ordered
column into slices, run the window inside each slice, and carry only one row per slice
across. Cut points are read to the driver first (a bounded list of numbers) and become
literals of the plan, so a recomputed task always sees the same slices.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

# Distinct values one task may sort on its own, and the most slices ever planned.
VALUES_PER_SLICE = 2_000_000
MAX_SLICES = 8_192

# Size of a quantile sketch: the rank error is about 2.3 / size ** 0.9. Tasks that merge first.
SKETCH_SIZE = 4_096
SKETCH_TASKS = 512

# A value is heavy when it holds more than this share of the table and this many rows.
HEAVY_SHARE = 0.0001
HEAVY_ROWS = 1_000_000


def sketch_error(size: int = SKETCH_SIZE) -> float:
    """Rank error, as a share of the rows, that a sketch of this size keeps to in 99 of 100 cases."""
    return 2.296 / size**0.9021


def sketched_quantiles(
    t: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], size: int = SKETCH_SIZE
) -> dict[str, list[float]]:
    """Approximate quantiles of several columns in one pass; a column without values has none.

    The sketches of the input partitions are merged by ``SKETCH_TASKS`` tasks before the last
    one puts theirs together, so its work does not grow with the table.
    """
    some = t.select(F.pmod(F.spark_partition_id(), F.lit(SKETCH_TASKS)).alias("_part"), *[c.cast("double").alias(n) for n, c in columns.items()])
    parts = some.groupBy("_part").agg(*[F.kll_sketch_agg_double(n, size).alias(n) for n in columns])
    merged = parts.agg(*[F.kll_merge_agg_double(n, size).alias(n) for n in columns])
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    row = merged.select(
        *[F.when(F.kll_sketch_get_n_double(n) > 0, F.kll_sketch_get_quantile_double(n, wanted)).alias(n) for n in columns]
    ).first()
    return {n: list(row[n] or []) for n in columns}


def plan_cuts(t: DataFrame, col: str, values_per_slice: int = VALUES_PER_SLICE) -> list[float]:
    """Cut points that split ``col`` into slices of about ``values_per_slice`` values.

    An empty list means that one slice is enough. Reads only the one column, and brings
    at most ``MAX_SLICES`` numbers to the driver. The cuts only balance the work: any
    list of cuts gives the same result.
    """
    value = F.col(col).cast("double")
    n_values = t.agg(F.approx_count_distinct(value)).first()[0]
    slices = min(MAX_SLICES, math.ceil(n_values / values_per_slice))
    if slices <= 1:
        return []
    probs = [i / slices for i in range(1, slices)]
    # slices of about equal size: the error of a cut is a fraction of a slice
    size = min(65_535, max(SKETCH_SIZE, 8 * slices))
    cuts = sketched_quantiles(t, {"cut": value}, probs, size)["cut"]
    return sorted({c for c in cuts if math.isfinite(c)})


def with_slice(t: DataFrame, col: str, cuts: Sequence[float], name: str = "_slice") -> DataFrame:
    """Number the slice a value falls into; a later slice holds only larger values.

    Slices are closed on the left. NULL and NaN go into slices of their own.
    """
    if not cuts:
        return t.withColumn(name, F.lit(0.0))
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    bucketizer = Bucketizer(
        splits=splits, inputCol="_value", outputCol=name, handleInvalid="keep"
    )
    return bucketizer.transform(t.withColumn("_value", F.col(col).cast("double"))).drop("_value")


def running_sums(
    counts: DataFrame,
    by: Sequence[str],
    order: str,
    sums: dict[str, str],
    cuts: Sequence[float] = (),
    descending: bool = False,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add running totals over ``order`` inside each ``by`` group, current row included.

    ``sums`` maps a new column to the column it accumulates, ``totals`` a new column to
    the column whose whole sum in the group it holds. ``counts`` has one row per
    (by, order) value. With ``cuts`` the work is spread over one task per (by, slice):
    each slice sums itself, and the totals of the slices before it are added.
    """
    totals = totals or {}
    key = F.col(order).desc() if descending else F.col(order).asc()
    upto = (Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    if not cuts:
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(*upto)
        return counts.withColumns(
            {new: F.sum(old).over(w) for new, old in sums.items()}
            | {new: F.sum(old).over(whole) for new, old in totals.items()}
        )

    sliced = with_slice(counts, order, cuts)
    inner = Window.partitionBy(*by, "_slice").orderBy(key).rowsBetween(*upto)
    sliced = sliced.withColumns({new: F.sum(old).over(inner) for new, old in sums.items()})

    # one row per (by, slice): at most MAX_SLICES rows in a group
    slice_key = F.col("_slice").desc() if descending else F.col("_slice").asc()
    before = whole.orderBy(slice_key).rowsBetween(Window.unboundedPreceding, -1)
    sources = dict.fromkeys([*sums.values(), *totals.values()])
    carried = (
        with_slice(counts, order, cuts)
        .groupBy(*by, "_slice")
        .agg(*[F.sum(old).alias(f"_sum_{old}") for old in sources])
        .select(
            *[F.col(b).alias(f"_by_{b}") for b in by],
            F.col("_slice").alias("_carry_slice"),
            *[
                F.coalesce(F.sum(f"_sum_{old}").over(before), F.lit(0)).alias(f"_before_{new}")
                for new, old in sums.items()
            ],
            *[F.sum(f"_sum_{old}").over(whole).alias(new) for new, old in totals.items()],
        )
    )
    match = F.col("_slice").eqNullSafe(F.col("_carry_slice"))
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    joined = sliced.join(carried, match).withColumns(
        {new: F.col(new) + F.col(f"_before_{new}") for new in sums}
    )
    return joined.select(*counts.columns, *sums, *totals)


def heavy_values(
    t: DataFrame, cols: Sequence[str], share: float = HEAVY_SHARE, min_rows: int = HEAVY_ROWS
) -> list[Row]:
    """Values that hold more than ``share`` of all rows, and more than ``min_rows`` rows.

    There can be at most ``1 / share`` of them, so the list fits the driver whatever the
    table holds. Counting is combined before the shuffle.
    """
    counted = t.groupBy(*cols).agg(F.count(F.lit(1)).alias("_rows"))
    # the total first: it is a metadata count on columnar files
    n = t.agg(F.count(F.lit(1))).first()[0]
    limit = max(min_rows, int(n * share))
    if n <= limit:
        return []
    return counted.where(F.col("_rows") > limit).select(*cols).collect()
