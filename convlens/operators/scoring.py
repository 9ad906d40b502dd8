"""Evaluation of predicted labels and scores.

Everything that depends on the order of the scores starts from one row per distinct
score with its positives and negatives, and uses sliced running sums over those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions.columns import count_where, quoted, ratio, round_half_up
from convlens.operators.shape import lengthen
from convlens.operators.slicing import VALUES_PER_SLICE, plan_cuts, running_sums


def classification_metrics(
    t: DataFrame, y: str, predicted: str, by: Sequence[str] = (), digits: int = 4
) -> DataFrame:
    """Confusion counts, precision, recall and F1; a zero denominator gives 0."""
    truth, guess = F.col(y) == 1, F.col(predicted) == 1
    a = t.groupBy(*by).agg(
        count_where(truth & guess).alias("tp"),
        count_where(~truth & guess).alias("fp"),
        count_where(truth & ~guess).alias("fn"),
        count_where(~truth & ~guess).alias("tn"),
    )

    def score(num, den):
        return round_half_up(F.coalesce(ratio(num, den), F.lit(0.0)), digits)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.select(
        *by,
        score(tp, tp + fp).alias("precision"),
        score(tp, tp + fn).alias("recall"),
        score(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "tp",
        "fp",
        "fn",
        "tn",
    )


def score_table(
    t: DataFrame,
    y: str,
    score: str,
    by: Sequence[str] = (),
    values_per_slice: int = VALUES_PER_SLICE,
) -> DataFrame:
    """Per distinct score, highest first: its positives and negatives, and both running totals.

    ``up_pos`` and ``up_neg`` count the rows with this score or a higher one, ``all_pos``
    and ``all_neg`` all rows of the group. Rows without a score are left out.
    """
    cuts = plan_cuts(t, score, values_per_slice)
    value = quoted(score).cast("double")
    counts = (
        t.where(value.isNotNull() & ~F.isnan(value))
        .groupBy(*by, value.alias("score"))
        .agg(
            count_where(F.col(y) == 1).alias("pos"),
            count_where(F.col(y) != 1).alias("neg"),
        )
    )
    return running_sums(
        counts,
        by,
        "score",
        {"up_pos": "pos", "up_neg": "neg"},
        cuts,
        descending=True,
        totals={"all_pos": "pos", "all_neg": "neg"},
    )


def ranking_metrics(scores: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """ROC-AUC (ties count half) and step-wise average precision of a ``score_table``."""
    lower_neg = F.col("all_neg") - F.col("up_neg")
    pairs = F.col("pos") * (lower_neg + F.col("neg") / F.lit(2.0))
    step = ratio("pos", "all_pos") * ratio("up_pos", F.col("up_pos") + F.col("up_neg"))
    return scores.groupBy(*by).agg(
        round_half_up(
            ratio(F.sum(pairs), F.max(F.col("all_pos").cast("double") * F.col("all_neg"))), digits
        ).alias("roc_auc"),
        round_half_up(F.sum(step), digits).alias("pr_auc"),
    )


def roc_auc(t: DataFrame, y: str, score: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    return ranking_metrics(score_table(t, y, score, by), by, digits).drop("pr_auc")


def average_precision(
    t: DataFrame, y: str, score: str, by: Sequence[str] = (), digits: int = 6
) -> DataFrame:
    return ranking_metrics(score_table(t, y, score, by), by, digits).drop("roc_auc")


def curves(
    t: DataFrame, y: str, score: str, by: Sequence[str] = (), digits: int = 6
) -> DataFrame:
    """Points of the ROC and the precision-recall curve, one per distinct score.

    The start of both curves (nothing selected yet) is the row without a threshold.
    """
    table = score_table(t, y, score, by)
    points = table.select(
        *by,
        F.col("score").alias("threshold"),
        round_half_up(ratio("up_neg", "all_neg"), digits).alias("fpr"),
        round_half_up(ratio("up_pos", "all_pos"), digits).alias("tpr"),
        round_half_up(ratio("up_pos", F.col("up_pos") + F.col("up_neg")), digits).alias(
            "precision"
        ),
    )
    start = (
        t.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *by,
            F.lit(None).cast("double").alias("threshold"),
            F.lit(0.0).alias("fpr"),
            F.lit(0.0).alias("tpr"),
            F.lit(1.0).alias("precision"),
        )
    )
    return points.unionByName(start)


def targeting(
    t: DataFrame,
    y: str,
    score: str,
    shares: Sequence[float],
    cost_per_call: float = 5.0,
    value_per_sale: float = 500.0,
    digits: int = 4,
) -> DataFrame:
    """What calling the best-scored share of the table brings.

    A share is filled up to the score at which it is reached; rows with that same score
    are all called. ROI is revenue per cost.
    """
    table = score_table(t, y, score).withColumns(
        {
            "calls": F.col("up_pos") + F.col("up_neg"),
            "total": F.col("all_pos") + F.col("all_neg"),
        }
    )
    rows = []
    for i, share in enumerate(shares):
        reached = F.col("calls") >= F.lit(share) * F.col("total")
        first = F.struct("calls", "score", "up_pos")
        rows.append(F.min(F.when(reached, first)).alias(f"s{i}"))
    row = table.agg(*rows, F.max("all_pos").alias("positives"), F.max("total").alias("total"))
    out = lengthen(
        row,
        [
            {"share": float(share), "s": F.col(f"s{i}"), "positives": F.col("positives"),
             "total": F.col("total")}
            for i, share in enumerate(shares)
        ],
    )
    calls, hits = F.col("s.calls"), F.col("s.up_pos")
    precision = ratio(hits, calls)
    cost, revenue = calls * F.lit(cost_per_call), hits * F.lit(value_per_sale)
    return out.select(
        "share",
        F.col("s.score").alias("threshold"),
        calls.alias("calls"),
        hits.alias("conversions"),
        round_half_up(precision, digits).alias("precision"),
        round_half_up(ratio(hits, "positives"), digits).alias("recall"),
        round_half_up(ratio(precision, ratio("positives", "total")), digits).alias("lift"),
        cost.alias("cost"),
        revenue.alias("revenue"),
        round_half_up(ratio(revenue, cost), 2).alias("roi"),
    )
