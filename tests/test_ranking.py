import itertools
import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from convlens.operators.ranking import Standing

KIND = "g string, k int, x double, n long"


def _sorted(pdf):
    pdf = pdf.astype(object).where(pdf.notna(), None)
    return sorted(map(tuple, pdf.itertuples(index=False)), key=str)


def _rows():
    # ties, one value in a third of the rows, NULL keys and measures
    out = [("a" if i % 5 else None, i, float(i % 7) if i % 3 else 2.5, i % 4) for i in range(120)]
    return out + [("b", 200, 1.0, 3), ("a", 201, None, 1), ("b", 202, None, None)]


@pytest.mark.parametrize("per_slice, by", list(itertools.product([2, 1_000_000], [[], ["g"]])))
def test_standing_equals_windows(spark, per_slice, by):
    t = spark.createDataFrame(_rows(), KIND)
    place = Standing(t, by, per_slice).rank("x", "r").percent_rank("x", "p", 6).share("n", "s", 6)
    got = place.vs_mean("diff", "x", "d", 6).vs_mean("index", "x", "i", 6).table
    assert got.columns == ["g", "k", "x", "n", "r", "p", "s", "d", "i"]
    rows = pd.DataFrame(_rows(), columns=["g", "k", "x", "n"]).astype({"n": "Int64"})  # noqa: F841
    part = "PARTITION BY g" if by else ""
    want = duckdb.sql(f"""SELECT g, k, x, n, rank() OVER ({part} ORDER BY x DESC NULLS LAST) AS r,
        round(100 * percent_rank() OVER ({part} ORDER BY x NULLS FIRST), 6) AS p,
        round(100.0 * n / sum(n) OVER ({part}), 6) AS s, round(x - avg(x) OVER ({part}), 6) AS d,
        round(x / avg(x) OVER ({part}), 6) AS i FROM rows""").df()
    for a, b in zip(_sorted(got.toPandas()), _sorted(want)):
        assert a[:2] == b[:2]
        for u, v in zip(a[2:], b[2:]):
            assert (u is None and v is None) or math.isclose(float(u), float(v), abs_tol=2e-6)


def test_standing_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], KIND)
    assert Standing(none).rank("x").percent_rank("x").share("n").vs_mean("diff", "x").table.count() == 0
    one = Standing(spark.createDataFrame([("a", 1, 3.0, 0)], KIND)).rank("x").percent_rank("x").share("n").table.first()
    assert (one["rank_by_conv"], one["conv_percent_rank"], one["pct_of_dataset"]) == (1, 0.0, None)
    with pytest.raises(ValueError, match="diff or index"):
        Standing(none).vs_mean("ratio", "x")


def test_no_task_sees_all_groups(spark):
    t = spark.range(0, 1000).select(F.col("id").cast("string").alias("g"), (F.col("id") % 97).cast("double").alias("x"))
    plan = Standing(t, (), 10).rank("x").table._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line or line.lstrip("+:- ").startswith("Window [")]
    # one by slice over the counts, the others over one row per slice
    assert any("_slice" in line for line in windows)
    assert Standing(t, (), 10).rank("x").table.agg(F.max("rank_by_conv")).first()[0] == 990  # 11 rows hold the least value
