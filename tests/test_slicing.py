import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from convlens.operators import percentiles as P
from convlens.operators import slicing


def _frame(spark, n=5000, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["a", "b"], n, p=[0.9, 0.1]),
            "x": np.round(rng.lognormal(2, 1, n), 2),
            "one": np.where(rng.random(n) < 0.4, 7.0, rng.random(n)),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def test_running_sums_do_not_depend_on_the_slices(spark):
    pdf, t = _frame(spark)
    counts = t.groupBy("g", "x").agg(F.count(F.lit(1)).alias("rows")).cache()
    for descending in (False, True):
        whole = slicing.running_sums(counts, ["g"], "x", {"upto": "rows"}, [], descending)
        cuts = slicing.plan_cuts(counts, "x", values_per_slice=50)
        assert len(cuts) > 10
        split = slicing.running_sums(counts, ["g"], "x", {"upto": "rows"}, cuts, descending)
        assert split.columns == whole.columns
        key = ["g", "x"]
        left = whole.toPandas().sort_values(key).reset_index(drop=True)
        right = split.toPandas().sort_values(key).reset_index(drop=True)
        pd.testing.assert_frame_equal(left, right)


def test_percentiles_equal_numpy_on_any_slicing(spark):
    pdf, t = _frame(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for per_slice in (10, 1_000_000):
        got = P.percentiles(t, ["x", "one"], probs, values_per_slice=per_slice)
        for c in ("x", "one"):
            np.testing.assert_allclose(got[c], np.quantile(pdf[c], probs), rtol=1e-12)


def test_percentiles_skip_missing_and_empty_columns(spark):
    t = spark.createDataFrame(
        [(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "a double, b double"
    )
    got = P.percentiles(t, ["a", "b"], [0.5])
    assert got == {"a": [2.0], "b": [None]}


def test_percentiles_recover_from_a_bad_bracket(spark):
    t = spark.range(0, 1000).select(F.col("id").cast("double").alias("v0"))
    wanted = [P._Wanted("v0", 0.5, 499, 500, 0.5, 900.0, 950.0)]
    assert P._select(t, wanted, 100) == {}


@pytest.mark.parametrize("per_slice", [20, 1_000_000])
def test_medians_by_group(spark, per_slice):
    pdf, t = _frame(spark)
    got = {r["g"]: r["median"] for r in P.median_by(t, ["g"], "x", per_slice).collect()}
    for g, x in pdf.groupby("g")["x"]:
        assert math.isclose(got[g], x.median(), rel_tol=1e-12)

    got = {
        r["g"]: r["approx_median"]
        for r in P.approx_median(t, ["g"], "x", digits=6, values_per_slice=per_slice).collect()
    }
    for g, x in pdf.groupby("g")["x"]:
        s = x.sort_values().to_numpy()
        rank = np.arange(1, len(s) + 1) / len(s)
        want = s[(rank >= 0.49) & (rank <= 0.51)].mean()
        assert math.isclose(got[g], want, abs_tol=1e-6)


def test_approx_median_of_a_tiny_group_is_null(spark):
    t = spark.createDataFrame([("a", 5.0)], "g string, x double")
    assert P.approx_median(t, ["g"], "x").first()["approx_median"] is None


def test_heavy_values(spark):
    t = spark.range(0, 900).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("k"))
    assert [r["k"] for r in slicing.heavy_values(t, ["k"], 0.01, 5)] == [1]
    assert slicing.heavy_values(t, ["k"], 0.01, 10_000) == []
