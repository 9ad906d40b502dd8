"""Routing of questions to prepared answers by ordered keyword rules, as a batch job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions.columns import contains_any, quoted, tier

# The categories and their keywords, most specific first. A keyword matches
# anywhere in the text, so "age" is also found in "average".
RULES: list[tuple[str, list[str]]] = [
    ("model_limitations", ["limitation", "limit", "weakness", "caveat", "drawback"]),
    (
        "recommendations",
        ["executive summary", "summary", "overview of the project", "summarise", "summarize"],
    ),
    ("features", ["feature", "important", "driver", "variable", "predictive", "predictor"]),
    ("poutcome", ["previous", "poutcome", "prior campaign", "retarget"]),
    (
        "recommendations",
        [
            "recommend",
            "should",
            "action",
            "invest",
            "strategy",
            "improve",
            "major finding",
            "key finding",
            "investigate",
        ],
    ),
    ("conversion_rate", ["conversion rate", "subscription rate", "how many", "overall rate"]),
    (
        "customer_groups",
        [
            "customer group",
            "segment",
            "which group",
            "which customer",
            "job",
            "education",
            "marital",
            "age",
            "demographic",
        ],
    ),
    ("campaign", ["month", "timing", "when to", "best time", "seasonal", "temporal"]),
    (
        "campaign",
        ["campaign", "contact", "channel", "cellular", "telephone", "frequency", "how many calls"],
    ),
    (
        "model",
        [
            "model",
            "random forest",
            "logistic",
            "f1",
            "auc",
            "precision",
            "recall",
            "accuracy",
            "ml",
            "predict",
            "perform",
        ],
    ),
]
DEFAULT = "default"
# Fixed value: the reply to a blank question.
BLANK_QUESTION = "Please provide a question."
CATEGORIES = [*dict.fromkeys(category for category, _ in RULES), DEFAULT]


def route(
    t: DataFrame,
    text: str,
    rules: Sequence[tuple[str, Sequence[str]]] = RULES,
    default: str = DEFAULT,
    name: str = "category",
) -> DataFrame:
    """Add the category of the first rule that has a keyword in the text."""
    cases = [(contains_any(quoted(text), words), category) for category, words in rules]
    return t.withColumn(name, tier(cases, default))


def answers_table(t: DataFrame, answers: Mapping[str, str]) -> DataFrame:
    return t.sparkSession.createDataFrame(
        list(answers.items()), "category string, answer string"
    )


def answer(t: DataFrame, answers: DataFrame, text: str, default: str = DEFAULT) -> DataFrame:
    """Attach the answer of the category, else the default one; a blank question is an error.

    ``answers`` has a ``category`` and an ``answer`` column, one row per category of the rules in
    use; two answers for one category stop the run when a question needs it.
    """
    several = F.concat(F.lit("more than one answer for "), F.col("category"))
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error(several).cast("string"))
    answers = answers.groupBy("category").agg(single.otherwise(F.min("answer")).alias("answer"))
    fallback = answers.where(F.col("category") == default).select("answer").scalar()
    blank = F.coalesce(F.length(F.trim(F.regexp_replace(quoted(text), r"\s+", " "))), F.lit(0)) == 0
    return t.join(answers, "category", "left").withColumns(
        {
            "answer": F.when(blank, BLANK_QUESTION).otherwise(F.coalesce("answer", fallback)),
            "source": F.when(blank, "error").otherwise("fallback"),
        }
    )


def route_summary(t: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    return t.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"))
