"""Binary classifiers: fit, score, cross-validate, compare.

Fitting runs on the executors; the driver holds model parameters and a row of metrics
per model. Tables that several fits read are staged or persisted by the caller once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.functions.columns import flag, round_half_up
from convlens.operators.forest import ForestModel, fit_forests, score_forest
from convlens.operators.scoring import classification_metrics, ranking_metrics, score_table
from convlens.operators.splitting import SEED, hash_number, prior_baseline, with_class_weights
from convlens.sources.staging import stage

METRICS = ["f1", "roc_auc", "pr_auc", "precision", "recall"]


def assert_no_leakage(features: Sequence[str], leaking: Sequence[str]) -> None:
    found = sorted(set(features) & set(leaking))
    if found:
        raise ValueError(f"leaking columns among the features: {found}")


Model = PipelineModel | ForestModel


@dataclass(frozen=True)
class Estimator:
    """A named way to fit a model on (train, features, label).

    ``fit_folds`` takes the fold column and the number of folds as well and gives, for each
    fold, the model of all rows outside it; without it every fold is a fit of its own.
    ``prepare`` (table, features, columns to keep) writes what all fits and scores of a
    cross-validation can share.
    """

    name: str
    fit: Callable[[DataFrame, Sequence[str], str], Model]
    fit_folds: Callable[[DataFrame, Sequence[str], str, str, int], dict[int, Model]] | None = None
    prepare: Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame] | None = None


#: The assembled feature columns. Assembling costs more than a step of the fit and a fit passes its
#: rows several times, so the vectors are staged first.
ASSEMBLED = "_assembled"


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=ASSEMBLED)


def with_vectors(t: DataFrame, features: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The columns ``kept`` and the features as one vector, written once."""
    return stage(_assembler(features).transform(t).select(*kept, ASSEMBLED), "vectors")


def logistic_regression(max_iter: int = 1000, c: float = 1.0) -> Estimator:
    """z-scores and an L2-penalised logistic regression with balanced classes.

    The penalty is given as C, the inverse of its weight against the summed loss; Spark
    averages the loss, so the weight becomes 1 / (C * rows).
    """

    def fit(train: DataFrame, features: Sequence[str], y: str) -> PipelineModel:
        if ASSEMBLED not in train.columns:
            train = with_vectors(train, features, [y])
        weighted = with_class_weights(train.select(y, ASSEMBLED), y)
        rows = weighted.count()
        stages = [
            StandardScaler(inputCol=ASSEMBLED, outputCol="features", withMean=True, withStd=True),
            LogisticRegression(
                labelCol=y,
                featuresCol="features",
                weightCol="weight",
                regParam=1.0 / (c * max(rows, 1)),
                elasticNetParam=0.0,
                standardization=False,
                maxIter=max_iter,
            ),
        ]
        fitted = Pipeline(stages=stages).fit(weighted)
        return PipelineModel([_assembler(features), *fitted.stages])

    return Estimator("M1 LogReg", fit, prepare=with_vectors)


def random_forest(
    trees: int = 200, depth: int = 15, min_leaf: int = 20, seed: int = SEED, key: str = "id"
) -> Estimator:
    """A forest with balanced classes, bagged by the row key; see ``forest``."""
    settings = {"trees": trees, "depth": depth, "min_leaf": min_leaf, "seed": seed}

    def fit(train: DataFrame, features: Sequence[str], y: str) -> ForestModel:
        return fit_forests(train, features, y, key, **settings)[-1]

    def fit_folds(
        t: DataFrame, features: Sequence[str], y: str, fold: str, folds: int
    ) -> dict[int, Model]:
        return fit_forests(t, features, y, key, fold, folds, whole=False, **settings)

    return Estimator("M2 RandomForest", fit, fit_folds)


def feature_list(model: Model) -> list[str]:
    """The feature columns a fitted model expects, in order."""
    if isinstance(model, ForestModel):
        return list(model.features)
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()


def score(model: Model, t: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``score``, the probability of the positive class."""
    if isinstance(model, PipelineModel) and ASSEMBLED in t.columns:
        return _transformed(PipelineModel(model.stages[1:]), t)
    missing = [c for c in feature_list(model) if c not in t.columns]
    if missing:
        raise ValueError(f"feature columns missing: {missing}")
    if isinstance(model, ForestModel):
        return score_forest(model, t)
    return _transformed(model, t)


def _transformed(model: PipelineModel, t: DataFrame) -> DataFrame:
    scored = model.transform(t).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*t.columns, "prediction", "score")


def evaluate(
    scored: DataFrame, y: str, name: str | None = None, digits: int = 4, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and the five metrics of a scored table, one row per ``by`` group."""
    labels = classification_metrics(scored, y, "prediction", by, digits)
    ranks = ranking_metrics(score_table(scored, y, "score", by), by, digits)
    if by:
        out = labels.join(ranks, list(by))
    else:
        pair = ranks.select(F.struct("roc_auc", "pr_auc").alias("r")).scalar()
        out = labels.withColumn("_r", pair).select("*", "_r.*").drop("_r")
    columns = ["precision", "recall", "f1", "roc_auc", "pr_auc", "tp", "fp", "fn", "tn"]
    model = [] if name is None else [F.lit(name).alias("model")]
    return out.select(*model, *by, *columns)


def summarise_folds(per_fold: DataFrame, digits: int = 4) -> DataFrame:
    """Mean and population deviation of each metric over the folds of a model."""
    return per_fold.groupBy("model").agg(
        *[
            round_half_up(f(m), digits).alias(f"test_{m}_{label}")
            for m in METRICS
            for label, f in [("mean", F.avg), ("std", F.stddev_pop)]
        ]
    )


BASELINE = "M0 Dummy"


def compare(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    y: str,
    key: str,
    estimators: Sequence[Estimator | None],
    digits: int = 4,
) -> DataFrame:
    """One evaluation row per model on the held-out rows; ``None`` is the prior baseline.

    All models are measured in one pass over their stacked scores.
    """

    def scored(estimator: Estimator | None) -> DataFrame:
        if estimator is None:
            name, out = BASELINE, prior_baseline(train, test, y, key)
        else:
            name, out = estimator.name, score(estimator.fit(train, features, y), test)
        return out.select(F.lit(name).alias("model"), y, "prediction", "score")

    return evaluate(_stacked([scored(e) for e in estimators], "model-scores"), y, None, digits, ["model"])


def _stacked(parts: Sequence[DataFrame], label: str) -> DataFrame:
    """All scored rows, written once: the metrics read them several times."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stage(out, label)


def _baseline_by_fold(t: DataFrame, y: str, key: str, fold: str, folds: int) -> DataFrame:
    """The prior baseline of each fold, from the classes of all other folds."""
    sizes = t.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("p")).collect()
    n, p = sum(r["n"] for r in sizes), sum(r["p"] or 0.0 for r in sizes)
    prior = F.lit(0.0)
    for r in sizes:  # one row a fold
        own = (p - (r["p"] or 0.0)) / (n - r["n"]) if n > r["n"] else 0.0
        prior = F.when(F.col(fold) == r[fold], F.lit(own)).otherwise(prior)
    drawn = hash_number(key, f"baseline-{SEED}") / F.lit(float(16**13))
    guess = flag(drawn < prior).cast("double")
    return t.where(F.col(fold).between(0, folds - 1)).select(fold, y, guess.alias("prediction"), guess.alias("score"))


def cross_scores(
    t: DataFrame,
    features: Sequence[str],
    y: str,
    key: str,
    estimators: Sequence[Estimator | None],
    fold: str = "fold",
    folds: int = 5,
    parallelism: int = 5,
) -> DataFrame:
    """model, fold, label, prediction, score: every row scored by the models that have not seen its fold.

    Up to ``parallelism`` fits run at a time, so that the small jobs of one fit fill the
    gaps of another; a fit that is left over would run alone.
    """

    def models(estimator: Estimator, t: DataFrame) -> dict[int, Model]:
        if estimator.fit_folds:
            return estimator.fit_folds(t, features, y, fold, folds)
        with ThreadPool(parallelism) as own:
            target = inheritable_thread_target(t.sparkSession)(lambda k: estimator.fit(t.where(F.col(fold) != k), features, y))
            return dict(enumerate(own.map(target, range(folds), chunksize=1)))

    parts = []
    for estimator in estimators:
        if estimator is None:
            parts.append(_baseline_by_fold(t, y, key, fold, folds).withColumn("model", F.lit(BASELINE)))
            continue
        own = estimator.prepare(t, features, [fold, y]) if estimator.prepare else t
        for k, model in models(estimator, own).items():
            out = score(model, own.where(F.col(fold) == k)).select(fold, y, "prediction", "score")
            parts.append(out.withColumn("model", F.lit(estimator.name)))
    return _stacked(parts, "cross-scores")


def cross_validate(
    t: DataFrame,
    features: Sequence[str],
    y: str,
    key: str,
    estimators: Sequence[Estimator | None],
    fold: str = "fold",
    folds: int = 5,
    digits: int = 4,
    parallelism: int = 5,
) -> DataFrame:
    """Mean and population deviation of each metric over the folds; one row per model."""
    scored = cross_scores(t, features, y, key, estimators, fold, folds, parallelism)
    return summarise_folds(evaluate(scored, y, None, 6, ["model", fold]), digits)


def feature_importance(model: ForestModel, t: DataFrame, top: int | None = None) -> DataFrame:
    """Impurity importances of a fitted forest, highest first; they sum to 1."""
    values = model.importances()
    rows = list(zip(feature_list(model), values))
    out = t.sparkSession.createDataFrame(rows, "feature string, importance double")
    out = out.orderBy(F.col("importance").desc(), "feature")
    return out.limit(top) if top else out


def best_model(evaluation: DataFrame, by: str = "f1") -> DataFrame:
    """The row with the highest metric; equal models go to the smaller name."""
    order = F.struct(-F.col(by), F.col("model"))
    row = F.struct(*evaluation.columns)
    return evaluation.agg(F.min_by(row, order).alias("r")).select("r.*")


def model_card(evaluation: DataFrame, cv: DataFrame) -> DataFrame:
    """Test metrics of each model beside its cross-validated ones."""
    return evaluation.join(cv, "model")


def save_model(model: Model, path: str) -> None:
    if isinstance(model, ForestModel):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> Model:
    try:
        return ForestModel.load(SparkSession.active(), path)
    except AnalysisException:  # no table of nodes: a pipeline
        return PipelineModel.load(path)


def feature_list_table(model: Model, t: DataFrame) -> DataFrame:
    """The ordered feature list as a table to keep beside the saved model."""
    rows = list(enumerate(feature_list(model)))
    return t.sparkSession.createDataFrame(rows, "position int, feature string")

