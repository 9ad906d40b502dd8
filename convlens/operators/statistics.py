"""Correlations, binned conversion and densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.functions.columns import (
    band,
    finite_or_null,
    quoted,
    round_half_up,
    sql_name,
    sql_text,
    tier,
)
from convlens.operators.conversion import HITS, N, RATE, conversion
from convlens.operators.percentiles import percentiles
from convlens.sources.staging import stage


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are present; NULL if either is constant.

    NaN and infinite values count as missing.
    """
    a, b = finite_or_null(a.cast("double")), finite_or_null(b.cast("double"))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_pairs(t: DataFrame, pairs: Sequence[tuple[str, str]], digits: int = 6) -> DataFrame:
    """Correlation of chosen pairs; long: feature_a, feature_b, r.

    A first pass finds mean, range and missing values of the columns (a row of numbers).
    Pairs of complete columns then need one sum of products each, of values shifted by
    their mean so that nothing cancels. Pairs with missing values use ``pearson``, as
    each has rows of its own.
    """
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(cols)}
    # as SQL text: hundreds of small expressions are slow to build one call at a time
    # x - x is 0 for every finite number and NaN for the others
    number = {c: f"CAST({sql_name(c)} AS DOUBLE)" for c in cols}
    value = {c: f"CASE WHEN {x} - {x} = 0D THEN {x} END" for c, x in number.items()}
    stats = t.selectExpr(
        "count(*) AS n",
        *[
            f"{f}({value[c]}) AS {name}{i}"
            for c, i in at.items()
            for name, f in [("n", "count"), ("m", "avg"), ("lo", "min"), ("hi", "max")]
        ],
    ).first()
    rows = stats["n"]
    constant = {c for c, i in at.items() if stats[f"lo{i}"] == stats[f"hi{i}"]}
    complete = {c for c, i in at.items() if stats[f"n{i}"] == rows} - constant
    shifted = {c: f"({value[c]} - {stats[f'm{at[c]}']!r}D)" for c in complete}

    sums = [f"sum({shifted[c]}) AS s{at[c]}" for c in complete]
    sums += [f"sum({shifted[c]} * {shifted[c]}) AS q{at[c]}" for c in complete]
    pairwise, records = [], []
    for k, (a, b) in enumerate(pairs):
        i, j = at[a], at[b]
        parts = ["NULL"] * 6  # xy, x, y, xx, yy of complete columns, or r itself
        if a in complete and b in complete:
            sums.append(f"sum({shifted[a]} * {shifted[b]}) AS p{k}")
            parts[:5] = f"p{k}", f"s{i}", f"s{j}", f"q{i}", f"q{j}"
        elif rows and not {a, b} & constant:  # no correlation with a constant
            pairwise.append(pearson(quoted(a), quoted(b)).alias(f"r{k}"))
            parts[5] = f"r{k}"
        parts = [f"CAST({x} AS DOUBLE)" for x in parts]
        records.append(f"{sql_text(a)}, {sql_text(b)}, {', '.join(parts)}")
    row = t.agg(F.lit(1).alias("one"), *[F.expr(x) for x in sums], *pairwise)
    long = row.selectExpr(
        f"stack({len(records)}, {', '.join(records)}) "
        "AS (feature_a, feature_b, xy, x, y, xx, yy, r)"
    )
    n = float(max(rows, 1))
    fast = f"try_divide(xy - x * y / {n}D, sqrt(xx - x * x / {n}D) * sqrt(yy - y * y / {n}D))"
    return long.selectExpr("feature_a", "feature_b", f"coalesce(r, {fast}) AS r").withColumn(
        "r", round_half_up("r", digits)
    )


def corr_matrix(t: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Full matrix in long form; each pair is computed once and listed in both orders."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    half = corr_pairs(t, pairs, digits)
    mirrored = half.where(F.col("feature_a") != F.col("feature_b")).select(
        F.explode(
            F.array(
                F.struct("feature_a", "feature_b", "r"),
                F.struct(
                    F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "r"
                ),
            )
        ).alias("e")
    ).select("e.*")
    return mirrored.unionByName(half.where(F.col("feature_a") == F.col("feature_b")))


def collinear(
    t: DataFrame, cols: Sequence[str], threshold: float = 0.7, digits: int = 6
) -> DataFrame:
    """Pairs of features (leave the label out of ``cols``) with |r| above the threshold."""
    pairs = [(b, a) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return corr_pairs(t, pairs, digits).where(F.abs("r") > threshold)


def target_corr(t: DataFrame, cols: Sequence[str], y: str, digits: int = 6) -> DataFrame:
    """Features ranked by the strength of their correlation with the label."""
    r = corr_pairs(t, [(c, y) for c in cols], digits)
    return r.select(
        F.col("feature_a").alias("feature"),
        F.col("r").alias("pearson_r"),
        F.abs("r").alias("abs_r"),
    ).orderBy(F.col("abs_r").desc_nulls_last(), "feature")


def _few_values(t: DataFrame, col: str, limit: int) -> int:
    """min(number of distinct values, limit), exactly; counts exactly only if it may matter."""
    v = quoted(col)
    about = t.agg(F.approx_count_distinct(v)).first()[0]
    if about > 4 * limit + 16:
        return limit
    return t.where(v.isNotNull()).select(v).distinct().limit(limit).count()


def quantile_conversion(
    t: DataFrame, col: str, y: str = "y_encoded", q: int = 8
) -> DataFrame:
    """Conversion by quantile bins: right-closed, the lowest value included.

    At most ``q`` bins; equal edges are merged, a constant column gives one bin.
    """
    bins = max(_few_values(t, col, q), 1)
    edges = percentiles(t, [col], [i / bins for i in range(bins + 1)])[col]
    edges = sorted({e for e in edges if e is not None})
    if len(edges) < 2:
        edges = (edges or [0.0]) * 2
    v = quoted(col).cast("double")
    bin_id = tier([(v <= F.lit(high), i) for i, high in enumerate(edges[1:])])
    res = conversion(t.where(v.isNotNull() & ~F.isnan(v)), {"bin": bin_id.cast("int")}, y)
    edge = F.array(*[F.lit(e) for e in edges])
    low, high = edge[F.col("bin")], edge[F.col("bin") + 1]
    return res.select(
        "bin",
        round_half_up(low, 6).alias("low"),
        round_half_up(high, 6).alias("high"),
        round_half_up((low + high) / 2.0, 6).alias("mid"),
        N,
        HITS,
        RATE,
    ).orderBy("bin")


def band_conversion(
    t: DataFrame,
    col: str,
    edges: Sequence[float],
    labels: Sequence[str],
    y: str = "y_encoded",
    include_lowest: bool = False,
) -> DataFrame:
    """Conversion by fixed right-closed bands; rows outside the bands are left out.

    The lowest edge itself is outside unless ``include_lowest`` is set.
    """
    name = "band"
    banded = band(quoted(col), edges, labels, include_lowest)
    return conversion(t.where(banded.isNotNull()), {name: banded}, y).orderBy(name)


def _range(t: DataFrame, col: str) -> tuple[float, float] | None:
    v = quoted(col).cast("double")
    v = F.when(~F.isnan(v), v)
    low, high = t.agg(F.min(v), F.max(v)).first()
    return None if low is None else (low, high)


def density(t: DataFrame, by: str, col: str, bins: int = 20, digits: int = 9) -> DataFrame:
    """Normalised histogram per group over the common range; each group integrates to 1."""
    bounds = _range(t, col)
    low, high = bounds or (0.0, 1.0)
    width = (high - low) / bins or 1.0
    v = quoted(col).cast("double")
    index = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = (
        t.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(by, index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # at most ``bins`` rows a group
    counts = counts.withColumn("_all", F.sum("rows").over(Window.partitionBy(by)))
    return counts.select(
        by,
        "bin",
        round_half_up(F.lit(low) + F.col("bin") * F.lit(width), 6).alias("low"),
        "rows",
        round_half_up(F.col("rows") / (F.col("_all") * F.lit(width)), digits).alias("density"),
    )


# Terms of the expansion below, and bins per bandwidth: the remainder is below 1e-15 of a kernel's height.
EXPANSION, BINS_PER_BANDWIDTH = 12, 4
# Beyond this many bandwidths a kernel is zero in double precision.
REACH = 39.0


def kernel_density(
    t: DataFrame, by: str, col: str, points: int = 1000, digits: int = 9
) -> DataFrame:
    """Gaussian kernel density per group on an even grid, with Scott's bandwidth.

    The grid spans the range of the group and half of it more on both sides. Values are counted in
    bins narrower than a bandwidth; a bin keeps the power sums of the distances from its middle, and
    the sum of its kernels at a point is their expansion in Hermite polynomials there. Work beside the
    two scans is bins times points, whatever the number of rows or distinct values. NULL, NaN and
    infinite values take no part; a group of equal values has no bandwidth and no rows.
    """
    v = finite_or_null(quoted(col).cast("double"))
    n = F.count(v)
    shape = t.groupBy(F.col(by).alias("_by")).agg(
        n.alias("_n"),
        (F.stddev(v) * F.pow(n.cast("double"), F.lit(-0.2))).alias("_h"),
        (F.min(v) - (F.max(v) - F.min(v)) * 0.5).alias("_from"),
        ((F.max(v) - F.min(v)) * 2.0 / F.lit(float(points - 1))).alias("_step"),
    )
    shape = stage(shape.where(F.col("_h") > 0), "kernel-shapes")
    least = shape.agg(F.min("_h")).first()[0]
    width = F.lit((least or 1.0) / BINS_PER_BANDWIDTH)

    # distances in widths of a bin, so that their powers stay small
    place = t.where(v.isNotNull()).select(F.col(by), (v / width).alias("_at"))
    place = place.withColumn("_bin", F.round("_at")).withColumn("_off", F.col("_at") - F.col("_bin"))
    power, sums = F.lit(1.0), []
    for k in range(EXPANSION):
        sums.append(F.sum(power).alias(f"_m{k}"))
        power = power * F.col("_off")
    bins = place.groupBy(by, "_bin").agg(*sums)

    # a column for each term: in units of the bandwidth, divided by the factorial
    bins = bins.join(shape, F.col(by).eqNullSafe(F.col("_by")))
    unit = width / F.col("_h")
    terms = [F.col(f"_m{k}") * F.pow(unit, F.lit(float(k))) / math.factorial(k) for k in range(EXPANSION)]
    bins = bins.select(
        by, "_n", "_h", "_from", "_step", (F.col("_bin") * width).alias("_middle"),
        *[c.alias(f"_c{k}") for k, c in enumerate(terms)],
    )
    cells = bins.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    cells = cells.withColumn("_x", F.col("_from") + F.col("point") * F.col("_step"))
    cells = cells.withColumn("_z", (F.col("_x") - F.col("_middle")) / F.col("_h"))
    # sum of c_k He_k(z) from the last term down (Clenshaw): He_{k+1} = z He_k - k He_{k-1}
    z = F.col("_z")
    cells = cells.withColumn(f"_b{EXPANSION}", F.lit(0.0)).withColumn(f"_b{EXPANSION + 1}", F.lit(0.0))
    for k in reversed(range(EXPANSION)):
        term = F.col(f"_c{k}") + z * F.col(f"_b{k + 1}") - F.lit(float(k + 1)) * F.col(f"_b{k + 2}")
        cells = cells.withColumn(f"_b{k}", term)
    near = F.abs(z) < REACH
    kernels = F.when(near, F.col("_b0") * F.exp(-0.5 * z * z)).otherwise(F.lit(0.0))
    scale = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2.0 * math.pi))
    return cells.groupBy(by, "point").agg(
        round_half_up(F.max("_x"), 6).alias("x"),
        round_half_up(F.greatest(F.sum(kernels / scale), F.lit(0.0)), digits).alias("density"),
    )
