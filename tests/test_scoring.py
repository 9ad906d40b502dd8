import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from convlens.operators import scoring as S


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    n = 3000
    score = np.round(rng.random(n), 2)  # ties
    return pd.DataFrame(
        {
            "score": score,
            "y": (rng.random(n) < 0.2 + 0.5 * score).astype("int32"),
            "m": rng.choice(["a", "b"], n),
        }
    )


@pytest.fixture(scope="module")
def t(spark, pdf):
    return spark.createDataFrame(pdf).cache()


def _auc(p):
    pos, neg = p.loc[p.y == 1, "score"].to_numpy(), p.loc[p.y == 0, "score"].to_numpy()
    diff = pos[:, None] - neg
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size


def _average_precision(p):
    total, ap, hits, calls = (p.y == 1).sum(), 0.0, 0, 0
    for _, g in sorted(p.groupby("score"), key=lambda x: -x[0]):
        hits, calls = hits + g.y.sum(), calls + len(g)
        ap += g.y.sum() / total * hits / calls
    return ap


@pytest.mark.parametrize("per_slice", [7, 1_000_000])
def test_ranking_metrics_equal_brute_force(t, pdf, per_slice):
    table = S.score_table(t, "y", "score", ["m"], per_slice)
    got = {r["m"]: r for r in S.ranking_metrics(table, ["m"]).collect()}
    for m, p in pdf.groupby("m"):
        assert got[m]["roc_auc"] == pytest.approx(_auc(p), abs=1e-6)
        assert got[m]["pr_auc"] == pytest.approx(_average_precision(p), abs=1e-6)
    whole = S.ranking_metrics(S.score_table(t, "y", "score", values_per_slice=per_slice)).first()
    assert whole["roc_auc"] == pytest.approx(_auc(pdf), abs=1e-6)


def test_turning_the_score_around_mirrors_the_auc(t):
    turned = t.withColumn("back", -F.col("score"))
    a = S.roc_auc(t, "y", "score").first()[0]
    b = S.roc_auc(turned, "y", "back").first()[0]
    assert a + b == pytest.approx(1.0, abs=2e-6)


def test_degenerate_scores(spark):
    t = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y int, score double")
    assert S.roc_auc(t, "y", "score").first()[0] == 0.5
    assert S.average_precision(t, "y", "score").first()[0] == pytest.approx(1 / 3, abs=1e-6)
    assert S.roc_auc(t.where("y = 1"), "y", "score").first()[0] is None
    assert S.roc_auc(t.where("y = 0"), "y", "score").first()[0] is None


def test_curves_start_at_nothing_and_end_at_everything(t):
    points = S.curves(t, "y", "score").orderBy(F.col("threshold").desc_nulls_first()).collect()
    assert tuple(points[0]) == (None, 0.0, 0.0, 1.0)
    assert (points[-1]["fpr"], points[-1]["tpr"]) == (1.0, 1.0)
    assert len(points) == t.select("score").distinct().count() + 1
    trapezoid = sum(
        (b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(points, points[1:])
    )
    assert trapezoid == pytest.approx(S.roc_auc(t, "y", "score").first()[0], abs=1e-4)


def test_confusion_counts_and_zero_division(spark):
    t = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "y int, p int")
    r = S.classification_metrics(t, "y", "p").first()
    assert tuple(r) == (0.5, 0.5, 0.5, 1, 1, 1, 2)
    none = S.classification_metrics(t.where("p = 0 and y = 0"), "y", "p").first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0, 0, 0, 2)


def test_targeting_fills_a_share_with_whole_ties(spark):
    rows = [(1, 0.9)] * 4 + [(0, 0.9)] + [(1, 0.5)] + [(0, 0.5)] * 4 + [(0, 0.1)] * 10
    t = spark.createDataFrame(rows, "y int, score double")
    got = {r["share"]: r for r in S.targeting(t, "y", "score", [0.1, 0.5, 1.0]).collect()}
    assert (got[0.1]["calls"], got[0.1]["conversions"], got[0.1]["threshold"]) == (5, 4, 0.9)
    assert (got[0.1]["precision"], got[0.1]["recall"], got[0.1]["lift"]) == (0.8, 0.8, 3.2)
    assert (got[0.1]["cost"], got[0.1]["revenue"], got[0.1]["roi"]) == (25.0, 2000.0, 80.0)
    assert got[0.5]["calls"] == 10 and got[1.0]["calls"] == 20 and got[1.0]["lift"] == 1.0
