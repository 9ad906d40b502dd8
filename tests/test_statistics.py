import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from convlens.operators import features as FE
from convlens.operators import profiling as P
from convlens.operators import statistics as ST
from convlens.sources.tables import drop_columns


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 2000
    x = rng.normal(1e6, 1.0, n)  # far from zero: sums of squares would cancel
    return pd.DataFrame(
        {
            "x": x,
            "z": 0.95 * (x - 1e6) + 0.3 * rng.normal(size=n),
            "holes": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
            "flat": 0.1,
            "y": (rng.random(n) < 0.3).astype("int32"),
            "g": rng.choice(["a", "b"], n),
        }
    )


@pytest.fixture(scope="module")
def t(spark, pdf):
    return spark.createDataFrame(pdf).replace(float("nan"), None).cache()


def test_correlations_equal_pandas(t, pdf):
    cols = ["x", "z", "holes", "flat", "y"]
    want = pdf[cols].corr()
    rows = ST.corr_matrix(t, cols).collect()
    assert len(rows) == 25
    for r in rows:
        w = want.loc[r["feature_a"], r["feature_b"]]
        if "flat" in (r["feature_a"], r["feature_b"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(w, abs=2e-6)


def test_collinear_pairs_and_ranking(t):
    pairs = [(r["feature_a"], r["feature_b"]) for r in ST.collinear(t, ["x", "z", "holes"]).collect()]
    assert pairs == [("z", "x")]
    ranked = [r["feature"] for r in ST.target_corr(t, ["flat", "x", "z"], "y").collect()]
    assert ranked[-1] == "flat"


def test_correlation_of_an_empty_table_is_null(t):
    assert ST.corr_pairs(t.limit(0), [("x", "z")]).first()["r"] is None


def test_moments_equal_pandas(t, pdf):
    got = {r["column"]: r for r in P.describe(t, ["z", "holes", "flat"]).collect()}
    for c in ("z", "holes"):
        d = pdf[c].describe()
        for name, key in [("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")]:
            assert got[c][name] == pytest.approx(d[key], abs=1e-4)
        assert got[c]["skewness"] == pytest.approx(pdf[c].skew(), abs=1e-4)
        assert got[c]["kurtosis"] == pytest.approx(pdf[c].kurt(), abs=1e-4)
        assert got[c]["count"] == d["count"]
    assert got["flat"]["skewness"] is None


@pytest.mark.parametrize("values", [range(100), [1] * 60 + [2] * 30 + list(range(3, 13)), [4] * 9, [1, 2]])
def test_quantile_bins_equal_pandas(spark, values):
    pdf = pd.DataFrame({"v": list(values)})
    pdf["y_encoded"] = (pdf["v"] % 3 == 0).astype("int32")
    q = min(pdf["v"].nunique(), 8)
    bins = pd.qcut(pdf["v"], q, duplicates="drop")
    want = pdf.groupby(bins, observed=True)["y_encoded"].agg(["count", "sum"])
    got = ST.quantile_conversion(spark.createDataFrame(pdf), "v").collect()
    assert [(r["total_clients"], r["subscribed"]) for r in got] == [tuple(w) for w in want.to_numpy()]


def test_bands_leave_out_the_lowest_edge(spark):
    t = spark.createDataFrame([(17, 1), (18, 1), (100, 0), (101, 1)], "age int, y_encoded int")
    got = ST.band_conversion(t, "age", [17, 65, 100], ["young", "old"]).collect()
    assert [(r["band"], r["total_clients"]) for r in got] == [("old", 1), ("young", 1)]


def test_histograms_and_kernels_integrate_to_one(t, pdf):
    got = ST.density(t, "g", "z", bins=16).toPandas()
    width = (pdf["z"].max() - pdf["z"].min()) / 16
    assert np.allclose(got.groupby("g")["density"].sum() * width, 1.0)

    got = ST.kernel_density(t, "g", "z", points=200).toPandas().sort_values("point")
    for g, part in got.groupby("g"):
        v = pdf.loc[pdf["g"] == g, "z"].to_numpy()
        h = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min() - np.ptp(v) / 2, v.max() + np.ptp(v) / 2, 200)
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        np.testing.assert_allclose(part["density"], want, atol=1e-8)
        assert np.trapezoid(part["density"], part["x"]) == pytest.approx(1.0, abs=1e-3)


def test_one_hot_leaves_out_the_first_level(spark):
    t = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, None)], "id int, v string")
    out = FE.one_hot(t, ["v"])
    assert out.columns == ["id", "v_b", "v_c"]
    assert {r["id"]: (r["v_b"], r["v_c"]) for r in out.collect()} == {
        1: (1, 0), 2: (0, 0), 3: (0, 1), 4: (0, 0)
    }
    later = FE.one_hot(spark.createDataFrame([(9, "c")], "id int, v string"), ["v"], {"v": ["a", "b", "c"]})
    assert tuple(later.first()) == (9, 0, 1)
    with pytest.raises(ValueError, match="levels"):
        FE.category_levels(t, ["v"], max_levels=2)


def test_drop_ignores_absent_columns(t):
    assert drop_columns(t, ["x", "nothing"]).columns == ["z", "holes", "flat", "y", "g"]


@pytest.mark.parametrize("spread", [1.0, 1e-6, 1e7])
def test_kernels_do_not_depend_on_the_number_of_distinct_values(spark, spread):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 20_000, p=[0.8, 0.2]), "v": rng.normal(3, 1, 20_000) * spread})
    pdf.loc[0, "v"] = 400 * spread  # far out
    pdf.loc[pdf["g"] == "b", "v"] *= 20  # another bandwidth
    t = spark.createDataFrame(pdf)
    odd = spark.createDataFrame([("a", None), ("b", float("nan")), ("a", float("inf")), ("c", 1.0), ("c", 1.0)], t.schema)
    got = ST.kernel_density(t.unionByName(odd), "g", "v", points=100, digits=15).toPandas().sort_values("point")
    assert set(got["g"]) == {"a", "b"}
    for g, part in got.groupby("g"):
        v = pdf.loc[pdf["g"] == g, "v"].to_numpy()
        h = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min() - np.ptp(v) / 2, v.max() + np.ptp(v) / 2, 100)
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        np.testing.assert_allclose(part["density"], want, atol=1e-11 * want.max() + 1e-15)


def test_kernels_of_an_empty_table(spark):
    assert ST.kernel_density(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def _active(t, col):
    """key -> (size, active positions) of a column of sparse vectors."""
    rows = t.select("id", F.unwrap_udt(f"`{col}`").alias("v")).select("id", "v.size", "v.indices").collect()
    return {r["id"]: (r["size"], r["indices"]) for r in rows}


def test_sparse_vectors_equal_the_wide_form(spark):
    rows = [(i, None if i % 9 == 0 else "klmnop"[i * i % 6], f"w{i % 4}") for i in range(60)]
    t = spark.createDataFrame(rows, "id int, `v.x` string, w string")
    wide = FE.one_hot(t, ["v.x", "w"])
    got = FE.one_hot_sparse(t, ["v.x", "w"])
    assert got.columns == ["id", "v.x_one_hot", "w_one_hot"]
    for c in ("v.x", "w"):
        names = [k for k in wide.columns if k.startswith(f"{c}_")]
        want = {r["id"]: (len(names), [i for i, k in enumerate(names) if r[k]]) for r in wide.collect()}
        assert _active(got, f"{c}_one_hot") == want


def test_sparse_vectors_of_many_few_and_unseen_levels(spark):
    t = spark.range(0, 100_000).select("id", F.format_string("l%06d", "id").alias("v"))
    levels = {"v": FE.level_positions(t, "v")}
    assert levels["v"][1] == 100_000
    new = spark.createDataFrame([(0, "l000000"), (1, "l000001"), (2, "l099999"), (3, "other"), (4, None)], "id int, v string")
    got = _active(FE.one_hot_sparse(new, ["v"], levels), "v_one_hot")
    assert got == {0: (99_999, []), 1: (99_999, [0]), 2: (99_999, [99_998]), 3: (99_999, []), 4: (99_999, [])}
    one = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert _active(FE.one_hot_sparse(one, ["v"]), "v_one_hot") == {1: (1, []), 2: (1, [])}
    assert FE.one_hot_sparse(one.limit(0), ["v"]).count() == 0
