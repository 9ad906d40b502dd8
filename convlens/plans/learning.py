"""Statistics, features, splits, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.functions.columns import (
    band,
    flag,
    map_codes,
    ordinal,
    ratio,
    round_half_up,
    strip_sentinel,
    tier,
)
from convlens.operators import features as FE
from convlens.operators import modelling as M
from convlens.operators import scoring as S
from convlens.operators import splitting as SP
from convlens.operators import statistics as ST
from convlens.operators.conversion import overview
from convlens.operators.percentiles import median_by as exact_median
from convlens.plans.segments import AGE_EDGES, AGE_LABELS, MEASURES, PRIORITIES, WITH, pct, rnd
from convlens.sources.contacts import NO_HISTORY, contacts, contacts_once, read
from convlens.sources.staging import stage

# Calendar order, leaking and collinear columns.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
LEAKING = ["duration"]
COLLINEAR = ["price", "balance"]
ONE_HOT = ["segment", "region", "contact", "poutcome"]
NOT_FEATURES = ["id", "y", "y_encoded", "priority", "month", "day_of_week", "nation",
                "age_group", "campaign_group", "recency_group", "split", "fold"]
RULE_LIMITS = {"quantity": 25.0, "unit_price": 1500.0}
NUMERIC = ["age", "duration", "price", "balance", "campaign", "previous", "pdays"]


def feature_spec() -> FE.FeatureSpec:
    n, pdays = F.col("campaign"), F.col("pdays")
    return FE.FeatureSpec(
        drop=[*LEAKING, *COLLINEAR, "contact_date"],
        capped={"previous_capped": ("previous", 0.99)},
        one_hot=ONE_HOT,
        features=[
            FE.Feature(
                "age_group", band("age", AGE_EDGES, AGE_LABELS),
                "bands of age", "Effect of age is not linear", "string", "age",
            ),
            FE.Feature(
                "campaign_group",
                tier([(n == 1, "first"), (n <= 3, "optimal"), (n <= 6, "diminishing")],
                     "over_contacted"),
                "tiers of the contact count", "Rates fall with the count", "string", "campaign",
            ),
            FE.Feature(
                "pdays_actual", strip_sentinel("pdays", NO_HISTORY),
                "-1 for the sentinel", "999 is no number of days", "int", "pdays",
            ),
            FE.Feature(
                "recency_group",
                tier([(pdays == NO_HISTORY, "no_prior"), (pdays <= 3, "very_recent"),
                      (pdays <= 7, "recent"), (pdays <= 14, "moderate")], "distant"),
                "groups of days since the last contact", "Effect is not linear",
                "string", "pdays",
            ),
            FE.Feature(
                "repeat_success",
                flag((F.col("previously_contacted") == 1) & (F.col("poutcome") == "success")),
                "seen before and sold", "Interaction", "int (0/1)",
                "previously_contacted, poutcome",
            ),
            FE.Feature(
                "cellular_first", flag((F.col("contact") == "cellular") & (n == 1)),
                "first contact by cellular", "Interaction", "int (0/1)", "contact, campaign",
            ),
            FE.Feature(
                "high_value_segment",
                flag(F.col("segment").isin("BUILDING", "MACHINERY")
                     & (F.col("region") == "EUROPE")),
                "segment and region", "Interaction", "int (0/1)", "segment, region",
            ),
            FE.Feature(
                "priority_encoded", ordinal("priority", PRIORITIES, first=0, default=-1),
                "0..4, -1 unknown", "Levels are ordered", "int", "priority",
            ),
            FE.Feature("month_num", ordinal("month", MONTHS), "1..12", "Calendar order", "int", "month"),
            FE.Feature(
                "dow_num", map_codes("day_of_week", {d: i + 1 for i, d in enumerate(DAYS)}),
                "1..7", "Calendar order", "int", "day_of_week",
            ),
            FE.Feature(
                "log_campaign", F.log1p("campaign"), "log(1 + campaign)", "Skewed", "double",
                "campaign",
            ),
            FE.Feature(
                "log_previous", F.log1p("previous_capped"), "log(1 + previous_capped)", "Skewed",
                "double", "previous_capped",
            ),
            FE.Feature(
                "low_balance", flag(F.col("balance") < 2000.0), "balance < 2000", "Threshold",
                "int (0/1)", "balance",
            ),
        ],
    )


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return FE.build_features(contacts_once(spark, folder), feature_spec())


def features(spark: SparkSession, folder: str) -> DataFrame:
    t = feature_table(spark, folder)
    return t.withColumns({c: round_half_up(c, 9) for c in ["log_campaign", "log_previous"]})


def feature_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary, with the number of rows that have each feature."""
    t = feature_table(spark, folder)
    listed = FE.feature_dictionary(t, feature_spec())
    names = [r["feature"] for r in listed.select("feature").collect() if r["feature"] in t.columns]
    filled = t.agg(*[F.count(c).alias(c) for c in names])
    entries = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("rows_with_value")) for c in names]
    )
    return listed.join(filled.select(F.inline(entries)), "feature", "left")


def features_valid(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts_once(spark, folder)
    return FE.validate_features(
        t,
        FE.build_features(t, feature_spec()),
        "y_encoded",
        "y",
        "yes",
        absent=[*LEAKING, *COLLINEAR],
        binary=["repeat_success", "cellular_first"],
        domains={"priority_encoded": range(-1, 5)},
    )


def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return ST.corr_matrix(
        contacts_once(spark, folder, [*NUMERIC, "y_encoded"]), [*NUMERIC, "y_encoded"]
    )


def collinear(spark: SparkSession, folder: str) -> DataFrame:
    return ST.collinear(contacts_once(spark, folder, NUMERIC), NUMERIC)


def target_corr(spark: SparkSession, folder: str) -> DataFrame:
    t = feature_table(spark, folder)
    return ST.target_corr(t, FE.feature_columns(t, NOT_FEATURES), "y_encoded")


def quantile_conversion(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts_once(spark, folder, ["price", "y_encoded"], history=False)
    return ST.quantile_conversion(t, "price")


def quantile_conversion_ties(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts_once(spark, folder, ["previous", "y_encoded"])
    return ST.quantile_conversion(t, "previous")


def band_conversion(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "part").withColumn("y_encoded", flag(F.col("p_retailprice") > 1000))
    return ST.band_conversion(t, "p_size", [1, 10, 20, 30, 40, 50], list("abcde"))


def density(spark: SparkSession, folder: str) -> DataFrame:
    return ST.density(contacts_once(spark, folder, ["y", "age"], history=False), "y", "age", 20)


def kernel_density(spark: SparkSession, folder: str) -> DataFrame:
    return ST.kernel_density(contacts_once(spark, folder, ["y", "age"], history=False), "y", "age")


def median_by(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts_once(spark, folder, ["y", "price"], history=False)
    return exact_median(t, ["y"], "price").withColumn("median", round_half_up("median", 6))


def split_balance(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts(spark, folder, history=False)
    return overview(SP.stratified_split(t, "y_encoded", "id"), by=["split"])


def split_exact(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts_once(spark, folder, ["id", "y_encoded"], history=False)
    return SP.stratified_split(t, "y_encoded", "id", exact=True)


def folds(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts(spark, folder, history=False).select("id", "y_encoded")
    return SP.kfold(t, "id")


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts(spark, folder, history=False)
    return SP.class_weights(t, "y_encoded").withColumn("weight", round_half_up("weight", 9))


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts_once(spark, folder, ["id", "y_encoded"], history=False)
    t = SP.stratified_split(t, "y_encoded", "id")
    guessed = SP.prior_baseline(
        t.where("split = 'train'"), t.where("split = 'test'"), "y_encoded", "id"
    )
    return S.classification_metrics(guessed, "y_encoded", "prediction")


def _returned(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "lineitem")
    return t.select(
        "l_quantity",
        "l_linestatus",
        flag(F.col("l_returnflag") == "R").alias("y_encoded"),
        flag(F.col("l_quantity") > 25).alias("prediction"),
        ratio("l_extendedprice", "l_quantity").alias("unit_price"),
    )


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return S.classification_metrics(
        _returned(spark, folder), "y_encoded", "prediction", by=["l_linestatus"]
    )


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return S.roc_auc(_returned(spark, folder), "y_encoded", "l_quantity")


def avg_precision(spark: SparkSession, folder: str) -> DataFrame:
    return S.average_precision(
        _returned(spark, folder), "y_encoded", "unit_price", by=["l_linestatus"]
    )


def curves(spark: SparkSession, folder: str) -> DataFrame:
    return S.curves(_returned(spark, folder), "y_encoded", "l_quantity")


def targeting(spark: SparkSession, folder: str) -> DataFrame:
    return S.targeting(
        _returned(spark, folder), "y_encoded", "unit_price", [0.05, 0.1, 0.2, 0.35, 0.5, 1.0]
    )


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    """Two fixed scoring rules as models: every order line scored by both, with its fold."""
    t = read(spark, folder, "lineitem").select(
        "l_orderkey",
        flag(F.col("l_returnflag") == "R").alias("y_encoded"),
        F.col("l_quantity").alias("quantity"),
        ratio("l_extendedprice", "l_quantity").alias("unit_price"),
    )
    scores = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"),
                F.col(name).alias("score"),
                flag(F.col(name) > limit).alias("prediction"),
            )
            for name, limit in RULE_LIMITS.items()
        ]
    )
    return SP.kfold(t, "l_orderkey").select("y_encoded", "fold", F.inline(scores))


def rule_eval(spark: SparkSession, folder: str) -> DataFrame:
    return M.evaluate(_rules(spark, folder), "y_encoded", by=["model"])


def rule_card(spark: SparkSession, folder: str) -> DataFrame:
    t = _rules(spark, folder)
    per_fold = M.evaluate(t, "y_encoded", digits=6, by=["model", "fold"])
    return M.model_card(rule_eval(spark, folder), M.summarise_folds(per_fold))


def best_rule(spark: SparkSession, folder: str) -> DataFrame:
    return M.best_model(rule_eval(spark, folder))


# -- models -------------------------------------------------------------------


def _model_input(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    t = feature_table(spark, folder)
    columns = FE.feature_columns(t, NOT_FEATURES)
    M.assert_no_leakage(columns, LEAKING)
    t = SP.kfold(SP.stratified_split(t, "y_encoded", "id"), "id")
    # every fit reads it several times
    return stage(t.select("id", "y_encoded", "split", "fold", *columns), "features"), columns


def model_eval(spark: SparkSession, folder: str) -> DataFrame:
    t, columns = _model_input(spark, folder)
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    models = [None, M.logistic_regression(), M.random_forest()]
    return M.compare(train, test, columns, "y_encoded", "id", models)


def model_cv(spark: SparkSession, folder: str) -> DataFrame:
    t, columns = _model_input(spark, folder)
    train = t.where("split = 'train'")
    models = [None, M.logistic_regression(), M.random_forest()]
    return M.cross_validate(train, columns, "y_encoded", "id", models)


def baseline_cv(spark: SparkSession, folder: str) -> DataFrame:
    """The prior baseline cross-validated: each fold is guessed from the classes of the others."""
    t = contacts_once(spark, folder, ["id", "y_encoded"], history=False)
    t = SP.kfold(SP.stratified_split(t, "y_encoded", "id"), "id").where("split = 'train'")
    return M.cross_validate(t, [], "y_encoded", "id", [None])


def model_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for any fitted model: which rows each one scored, and that scores are probabilities."""
    t, columns = _model_input(spark, folder)
    models = [None, M.logistic_regression(20), M.random_forest(20, 6)]
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    held = M.compare(train, test, columns, "y_encoded", "id", models).select(
        F.lit("held out").alias("rows_of"), "model", F.lit(-1).alias("fold"),
        F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.col("tp") + F.col("fn"),
        F.col("precision").between(0, 1) & F.col("roc_auc").between(0, 1),
    )
    crossed = M.cross_scores(train, columns, "y_encoded", "id", models).groupBy("model", "fold")
    crossed = crossed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y_encoded").alias("n_positive"),
        F.every(F.col("score").between(0, 1) & F.col("prediction").isin(0.0, 1.0)).alias("in_range"),
    )
    names = ["rows_of", "model", "fold", "n_rows", "n_positive", "in_range"]
    return held.toDF(*names).unionByName(crossed.withColumn("rows_of", F.lit("cross-validation")))


def importance(spark: SparkSession, folder: str) -> DataFrame:
    t, columns = _model_input(spark, folder)
    model = M.random_forest().fit(t.where("split = 'train'"), columns, "y_encoded")
    return M.feature_importance(model, t, 20)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    t, columns = _model_input(spark, folder)
    model = M.logistic_regression().fit(t.where("split = 'train'"), columns, "y_encoded")
    out = M.score(model, t.where("split = 'test'"))
    return out.select("id", "y_encoded", "prediction", round_half_up("score", 4).alias("score"))


def one_hot_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each position of two sparse encodings, of customers (any number) and priorities."""
    t = read(spark, folder, "orders").select("o_custkey", "o_orderpriority")
    cols = ["o_custkey", "o_orderpriority"]
    t = FE.one_hot_sparse(t, cols)
    both = F.array(*[F.struct(F.lit(c).alias("column"), F.unwrap_udt(f"{c}_one_hot").alias("v")) for c in cols])
    t = t.select(F.inline(both)).select("column", F.col("v.size").alias("size"), F.explode_outer("v.indices").alias("position"))
    t = t.withColumn("position", F.coalesce("position", F.lit(-1)))  # all zeros
    return t.groupBy("column", "size", "position").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {
    f.__name__: f
    for f in [
        features,
        one_hot_sparse,
        feature_dictionary,
        features_valid,
        corr_matrix,
        collinear,
        target_corr,
        quantile_conversion,
        quantile_conversion_ties,
        band_conversion,
        density,
        kernel_density,
        median_by,
        split_balance,
        split_exact,
        folds,
        class_weights,
        baseline,
        confusion,
        roc_auc,
        avg_precision,
        curves,
        targeting,
        rule_eval,
        rule_card,
        best_rule,
        model_eval,
        model_cv,
        baseline_cv,
        model_checks,
        importance,
        scored,
    ]
}

# -- the same results in SQL --------------------------------------------------


def _levels_after_first(values: list[str], col: str) -> str:
    return ", ".join(
        f"CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS \"{col}_{v}\"" for v in sorted(values)[1:]
    )


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
CODES = {
    "month_num": ("month", {m: i + 1 for i, m in enumerate(MONTHS)}),
    "dow_num": ("day_of_week", {d: i + 1 for i, d in enumerate(DAYS)}),
    "priority_encoded": ("priority", {p: i for i, p in enumerate(PRIORITIES)}),
}


def _coded(name: str) -> str:
    col, codes = CODES[name]
    whens = " ".join(f"WHEN '{label}' THEN {code}" for label, code in codes.items())
    default = " ELSE -1" if name == "priority_encoded" else ""
    return f"CASE {col} {whens}{default} END AS {name}"


FEATURES_SQL = f"""
capped AS (
  SELECT *, CAST(least(previous, (SELECT floor(quantile_cont(previous, 0.99)) FROM contacts))
                 AS INTEGER) AS previous_capped
  FROM contacts),
features AS (
  SELECT id, y, y_encoded, priority, nation, age, month, day_of_week, campaign, previous, pdays,
         previously_contacted, previous_capped,
         CASE WHEN age < 17 THEN NULL WHEN age <= 25 THEN '18-25' WHEN age <= 35 THEN '26-35'
              WHEN age <= 45 THEN '36-45' WHEN age <= 55 THEN '46-55' WHEN age <= 65 THEN '56-65'
              WHEN age <= 100 THEN '66+' END AS age_group,
         CASE WHEN campaign = 1 THEN 'first' WHEN campaign <= 3 THEN 'optimal'
              WHEN campaign <= 6 THEN 'diminishing' ELSE 'over_contacted' END AS campaign_group,
         CASE WHEN pdays = 999 THEN -1 ELSE pdays END AS pdays_actual,
         CASE WHEN pdays = 999 THEN 'no_prior' WHEN pdays <= 3 THEN 'very_recent'
              WHEN pdays <= 7 THEN 'recent' WHEN pdays <= 14 THEN 'moderate'
              ELSE 'distant' END AS recency_group,
         CASE WHEN previously_contacted = 1 AND poutcome = 'success' THEN 1 ELSE 0 END
           AS repeat_success,
         CASE WHEN contact = 'cellular' AND campaign = 1 THEN 1 ELSE 0 END AS cellular_first,
         CASE WHEN segment IN ('BUILDING', 'MACHINERY') AND region = 'EUROPE' THEN 1 ELSE 0 END
           AS high_value_segment,
         {_coded("priority_encoded")}, {_coded("month_num")}, {_coded("dow_num")},
         ln(1 + campaign) AS log_campaign, ln(1 + previous_capped) AS log_previous,
         CASE WHEN balance < 2000.0 THEN 1 ELSE 0 END AS low_balance,
         {_levels_after_first(SEGMENTS, "segment")}, {_levels_after_first(REGIONS, "region")},
         {_levels_after_first(["cellular", "telephone"], "contact")},
         {_levels_after_first(["failure", "nonexistent", "success"], "poutcome")}
  FROM capped)"""

FEATURE_COLUMNS = [
    "age", "campaign", "previous", "pdays", "previously_contacted", "previous_capped",
    "pdays_actual", "repeat_success", "cellular_first", "high_value_segment", "priority_encoded",
    "month_num", "dow_num", "log_campaign", "log_previous", "low_balance",
    *[f"segment_{s}" for s in SEGMENTS[1:]], *[f"region_{r}" for r in REGIONS[1:]],
    "contact_telephone", "poutcome_nonexistent", "poutcome_success",
]


def _r(a: str, b: str) -> str:
    deviation = f'nullif(stddev_pop("{a}") * stddev_pop("{b}"), 0)'
    return rnd(f'(covar_pop("{a}", "{b}") / {deviation})', 6)


def _pair(a: str, b: str, source: str) -> str:
    return f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_r(a, b)} AS r FROM {source}"


_MATRIX = [*NUMERIC, "y_encoded"]


def _valid(name: str, actual: str, expected: str = "0") -> str:
    return f"SELECT '{name}' AS \"check\", {actual} AS actual, {expected} AS expected"


VALID_SQL = " UNION ALL ".join(
    [
        _valid("Row count preserved", "(SELECT count(*) FROM features)",
               "(SELECT count(*) FROM contacts)"),
        _valid("y_encoded sum preserved",
               "(SELECT CAST(sum(y_encoded) AS BIGINT) FROM features)",
               "(SELECT CAST(sum(y_encoded) AS BIGINT) FROM contacts)"),
        *[
            _valid(f"{c} is 0/1", f"(SELECT count(*) FROM features WHERE {c} NOT IN (0, 1))")
            for c in ["repeat_success", "cellular_first"]
        ],
        _valid("no new nulls", "(SELECT count(*) FROM features WHERE age_group IS NULL "
               "OR month_num IS NULL OR dow_num IS NULL)"),
        _valid("priority_encoded values valid",
               "(SELECT count(*) FROM features WHERE priority_encoded NOT BETWEEN -1 AND 4)"),
        _valid("y/y_encoded consistent",
               "(SELECT count(*) FROM features WHERE (y = 'yes') <> (y_encoded = 1))"),
        *[_valid(f"{c} excluded", "0") for c in [*LEAKING, *COLLINEAR]],
    ]
)


def _quantile_bins(col: str, bins: int) -> str:
    edges = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""e AS (SELECT list_sort(list_distinct(quantile_cont(CAST({col} AS DOUBLE), [{edges}])))
                 AS e FROM contacts),
      b AS (SELECT y_encoded, e,
                   greatest(len(list_filter(e, lambda x: x < {col})) - 1, 0) AS bin
            FROM contacts, e)
      SELECT CAST(bin AS INTEGER) AS bin, {rnd("any_value(e[bin + 1])", 6)} AS low,
             {rnd("any_value(e[bin + 2])", 6)} AS high,
             {rnd("any_value((e[bin + 1] + e[bin + 2]) / 2.0)", 6)} AS mid, {MEASURES}
      FROM b GROUP BY bin"""


HASH = "substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 8)"
FOLD = "CAST(CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':42'), 17, 8) AS BIGINT) % 5 AS INTEGER)"
RETURNED = """returned AS (
  SELECT l_quantity, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_encoded,
         CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS prediction,
         l_extendedprice / l_quantity AS unit_price
  FROM lineitem)"""


def _points(score: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""{RETURNED}, c AS (
        SELECT {cols}{score} AS score, sum(y_encoded) AS pos, sum(1 - y_encoded) AS neg
        FROM returned GROUP BY ALL),
      p AS (SELECT *, sum(pos) OVER d AS up_pos, sum(neg) OVER d AS up_neg,
                   sum(pos) OVER w AS all_pos, sum(neg) OVER w AS all_neg
            FROM c WINDOW d AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING),
                          w AS ({part}))"""


def _metrics(source: str, by: str = "") -> str:
    tp, fp, fn, tn = (
        f"count(*) FILTER (WHERE y_encoded = {y} AND prediction = {p})"
        for y, p in [(1, 1), (0, 1), (1, 0), (0, 0)]
    )

    def score(num: str, den: str) -> str:
        return rnd(f"coalesce(1.0 * ({num}) / nullif({den}, 0), 0)", 4)

    cols = f"{by}, " if by else ""
    return f"""SELECT {cols}{score(tp, f"{tp} + {fp}")} AS precision,
             {score(tp, f"{tp} + {fn}")} AS recall,
             {score(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")} AS f1,
             {tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn
      FROM {source} {"GROUP BY " + by if by else ""}"""


RULES_SQL = f"""rules AS (
  SELECT y_encoded, fold, m.model, m.score, m.prediction FROM (
    SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_encoded,
           CAST(CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || ':42'), 17, 8) AS BIGINT)
                % 5 AS INTEGER) AS fold,
           unnest([{", ".join(
               f"{{'model': '{name}', 'score': {score}, "
               f"'prediction': CASE WHEN {score} > {RULE_LIMITS[name]} THEN 1 ELSE 0 END}}"
               for name, score in [("quantity", "l_quantity"),
                                   ("unit_price", "l_extendedprice / l_quantity")])}]) AS m
    FROM lineitem))"""


def _rule_metrics(by: str, digits: int) -> str:
    counts = {
        name: f"count(*) FILTER (WHERE y_encoded = {y} AND prediction = {p})"
        for name, y, p in [("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)]
    }

    def score(num: str, den: str) -> str:
        return rnd(f"coalesce(1.0 * ({num}) / nullif({den}, 0), 0)", digits)

    tp, fp, fn = counts["tp"], counts["fp"], counts["fn"]
    return f"""(WITH c AS (
        SELECT {by}, score, sum(y_encoded) AS pos, sum(1 - y_encoded) AS neg
        FROM rules GROUP BY ALL),
      p AS (SELECT *, sum(pos) OVER d AS up_pos, sum(neg) OVER d AS up_neg,
                   sum(pos) OVER w AS all_pos, sum(neg) OVER w AS all_neg
            FROM c WINDOW d AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING),
                          w AS (PARTITION BY {by})),
      r AS (SELECT {by},
              {rnd("(sum(pos * (all_neg - up_neg + neg / 2.0)) / max(all_pos * all_neg))", digits)}
                AS roc_auc,
              {rnd("sum(pos / all_pos * up_pos / (up_pos + up_neg))", digits)} AS pr_auc
            FROM p GROUP BY ALL),
      l AS (SELECT {by}, {score(tp, f"{tp} + {fp}")} AS precision,
              {score(tp, f"{tp} + {fn}")} AS recall,
              {score(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")} AS f1,
              {", ".join(f"{c} AS {name}" for name, c in counts.items())}
            FROM rules GROUP BY ALL)
      SELECT * FROM l JOIN r USING ({by}))"""


def _fold_summary() -> str:
    return ", ".join(
        f"{rnd(f'{f}({m})', 4)} AS test_{m}_{label}"
        for m in M.METRICS
        for label, f in [("mean", "avg"), ("std", "stddev_pop")]
    )


def _positions_sql(col: str) -> str:
    return f"""SELECT '{col}' AS "column", max(r) OVER () - 1 AS size, r - 2 AS position, rows
      FROM (SELECT dense_rank() OVER (ORDER BY CAST({col} AS VARCHAR)) AS r, count(*) AS rows
            FROM orders GROUP BY {col})"""


ORACLE = {
    "one_hot_sparse": f"""SELECT "column", CAST(size AS INTEGER) AS size, CAST(position AS INTEGER) AS position, rows
      FROM ({_positions_sql("o_custkey")} UNION ALL {_positions_sql("o_orderpriority")})""",
    "rule_eval": f"WITH {RULES_SQL} SELECT * FROM {_rule_metrics('model', 4)}",
    "rule_card": f"""WITH {RULES_SQL}
      SELECT * FROM {_rule_metrics('model', 4)} JOIN (
        SELECT model, {_fold_summary()} FROM {_rule_metrics('model, fold', 6)} GROUP BY model)
      USING (model)""",
    "baseline_cv": f"""{WITH}, s AS (
        SELECT y_encoded, {FOLD} AS fold,
               CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':baseline-42'), 1, 13) AS BIGINT)
                 / 4503599627370496.0 AS drawn
        FROM contacts WHERE {HASH} >= '33333333'),
      n AS (SELECT fold, (sum(sum(y_encoded)) OVER () - sum(y_encoded))
                 / (sum(count(*)) OVER () - count(*)) AS p FROM s GROUP BY fold),
      rules AS (SELECT 'M0 Dummy' AS model, fold, y_encoded,
                       CASE WHEN drawn < p THEN 1 ELSE 0 END AS prediction,
                       CASE WHEN drawn < p THEN 1.0 ELSE 0.0 END AS score
                FROM s JOIN n USING (fold))
      SELECT model, {_fold_summary()} FROM {_rule_metrics('model, fold', 6)} GROUP BY model""",
    "model_checks": f"""{WITH}, s AS (
        SELECT y_encoded, {HASH} < '33333333' AS test, {FOLD} AS fold,
               unnest(['M0 Dummy', 'M1 LogReg', 'M2 RandomForest']) AS model
        FROM contacts)
      SELECT 'held out' AS rows_of, model, -1 AS fold, count(*) AS n_rows,
             CAST(sum(y_encoded) AS BIGINT) AS n_positive, true AS in_range
      FROM s WHERE test GROUP BY model
      UNION ALL
      SELECT 'cross-validation', model, fold, count(*), CAST(sum(y_encoded) AS BIGINT), true
      FROM s WHERE NOT test GROUP BY model, fold""",
    "best_rule": f"""WITH {RULES_SQL} SELECT * FROM {_rule_metrics('model', 4)}
      ORDER BY f1 DESC, model LIMIT 1""",
    "features": f"""{WITH}, {FEATURES_SQL}
      SELECT * REPLACE ({rnd("log_campaign", 9)} AS log_campaign,
                        {rnd("log_previous", 9)} AS log_previous)
      FROM features""",
    "features_valid": f"""{WITH}, {FEATURES_SQL}, v AS ({VALID_SQL})
      SELECT *, CASE WHEN actual = expected THEN 'PASS' ELSE 'FAIL' END AS passed FROM v""",
    "corr_matrix": WITH + " UNION ALL ".join(
        _pair(a, b, "contacts") if i <= j else
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_r(b, a)} AS r FROM contacts"
        for i, a in enumerate(_MATRIX) for j, b in enumerate(_MATRIX)
    ),
    "collinear": f"""{WITH}, m AS ({" UNION ALL ".join(
        _pair(b, a, "contacts") for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:])})
      SELECT * FROM m WHERE abs(r) > 0.7""",
    "target_corr": f"""{WITH}, {FEATURES_SQL}, m AS ({" UNION ALL ".join(
        _pair(c, "y_encoded", "features") for c in FEATURE_COLUMNS)})
      SELECT feature_a AS feature, r AS pearson_r, abs(r) AS abs_r FROM m""",
    "quantile_conversion": f"{WITH}, {_quantile_bins('price', 8)}",
    "quantile_conversion_ties": f"{WITH}, {_quantile_bins('previous', 8)}",
    "band_conversion": f"""WITH t AS (
        SELECT CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS y_encoded,
               CASE WHEN p_size <= 1 THEN NULL WHEN p_size <= 10 THEN 'a' WHEN p_size <= 20 THEN 'b'
                    WHEN p_size <= 30 THEN 'c' WHEN p_size <= 40 THEN 'd'
                    WHEN p_size <= 50 THEN 'e' END AS band
        FROM part)
      SELECT band, {MEASURES} FROM t WHERE band IS NOT NULL GROUP BY band""",
    "density": f"""{WITH}, r AS (
        SELECT CAST(min(age) AS DOUBLE) AS lo, (max(age) - min(age)) / 20.0 AS w FROM contacts),
      b AS (SELECT y, CAST(least(floor((age - lo) / w), 19) AS INTEGER) AS bin, count(*) AS rows,
                   any_value(lo) AS lo, any_value(w) AS w
            FROM contacts, r GROUP BY 1, 2)
      SELECT y, bin, {rnd("(lo + bin * w)", 6)} AS low, rows,
             {rnd("(rows / (sum(rows) OVER (PARTITION BY y) * w))", 9)} AS density
      FROM b""",
    "kernel_density": f"""{WITH}, s AS (
        SELECT y, count(*) AS n, stddev_samp(age) * power(count(*), -0.2) AS h,
               min(age) - (max(age) - min(age)) * 0.5 AS lo,
               (max(age) - min(age)) * 2.0 / 999.0 AS step
        FROM contacts GROUP BY y),
      c AS (SELECT y, age, count(*) AS rows FROM contacts GROUP BY y, age),
      g AS (SELECT c.y, point, age, rows, n, h, lo + point * step AS x
            FROM c JOIN s ON c.y = s.y, range(1000) g(point))
      SELECT y, CAST(point AS INTEGER) AS point, {rnd("max(x)", 6)} AS x,
             {rnd("sum(rows * exp(-0.5 * ((x - age) / h) ** 2) / (n * h * sqrt(2 * pi())))", 9)}
               AS density
      FROM g GROUP BY y, point""",
    "median_by": f"""{WITH} SELECT y, count(*) AS clients, {rnd("median(price)", 6)} AS median
      FROM contacts GROUP BY y""",
    "split_balance": f"""{WITH}, s AS (
        SELECT *, CASE WHEN {HASH} < '33333333' THEN 'test' ELSE 'train' END AS split FROM contacts)
      SELECT split, count(*) AS total_clients, CAST(sum(y_encoded) AS BIGINT) AS total_subscribed,
             CAST(count(*) - sum(y_encoded) AS BIGINT) AS total_not_subscribed,
             {pct("sum(y_encoded)", "count(*)")} AS subscription_rate_pct,
             {pct("count(*) - sum(y_encoded)", "count(*)")} AS non_subscription_rate_pct,
             {rnd("(1.0 * (count(*) - sum(y_encoded)) / nullif(sum(y_encoded), 0))", 1)}
               AS imbalance_ratio_no_per_yes
      FROM s GROUP BY split""",
    "split_exact": f"""{WITH}, r AS (
        SELECT id, y_encoded, row_number() OVER (PARTITION BY y_encoded
                 ORDER BY substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 13)) AS nr,
               count(*) OVER (PARTITION BY y_encoded) AS n
        FROM contacts)
      SELECT id, y_encoded, CASE WHEN nr <= floor(0.2 * n + 0.5) THEN 'test' ELSE 'train' END AS split
      FROM r""",
    "folds": f"""{WITH}
      SELECT id, y_encoded,
             CAST(CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':42'), 17, 8) AS BIGINT) % 5
                  AS INTEGER) AS fold
      FROM contacts""",
    "class_weights": f"""{WITH}, c AS (
        SELECT y_encoded, count(*) AS rows FROM contacts GROUP BY y_encoded)
      SELECT y_encoded, rows,
             {rnd("(sum(rows) OVER () / (count(*) OVER () * CAST(rows AS DOUBLE)))", 9)} AS weight
      FROM c""",
    "baseline": f"""{WITH}, s AS (
        SELECT id, y_encoded, {HASH} < '33333333' AS test,
               CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':baseline-42'), 1, 13) AS BIGINT)
                 / 4503599627370496.0 AS drawn
        FROM contacts),
      prior AS (SELECT avg(y_encoded) AS p FROM s WHERE NOT test),
      g AS (SELECT y_encoded, CASE WHEN drawn < p THEN 1 ELSE 0 END AS prediction
            FROM s, prior WHERE test)
      {_metrics("g")}""",
    "confusion": f"WITH {RETURNED} {_metrics('returned', 'l_linestatus')}",
    "roc_auc": f"""WITH {_points("l_quantity")}
      SELECT {rnd("(sum(pos * (all_neg - up_neg + neg / 2.0)) / max(all_pos * all_neg))", 6)}
               AS roc_auc
      FROM p""",
    "avg_precision": f"""WITH {_points("unit_price", "l_linestatus")}
      SELECT l_linestatus, {rnd("sum(pos / all_pos * up_pos / (up_pos + up_neg))", 6)} AS pr_auc
      FROM p GROUP BY l_linestatus""",
    "curves": f"""WITH {_points("l_quantity")}
      SELECT score AS threshold, {rnd("(up_neg / all_neg)", 6)} AS fpr,
             {rnd("(up_pos / all_pos)", 6)} AS tpr,
             {rnd("(up_pos / (up_pos + up_neg))", 6)} AS precision
      FROM p UNION ALL SELECT NULL, 0.0, 0.0, 1.0""",
    "targeting": f"""WITH {_points("unit_price")},
      s AS (SELECT unnest([0.05, 0.1, 0.2, 0.35, 0.5, 1.0]) AS share),
      f AS (SELECT CAST(share AS DOUBLE) AS share, max(score) AS threshold,
                   CAST(min(up_pos + up_neg) AS BIGINT) AS calls,
                   CAST(min(up_pos) AS BIGINT) AS conversions,
                   max(all_pos) AS positives, max(all_pos + all_neg) AS total
            FROM p, s WHERE up_pos + up_neg >= share * (all_pos + all_neg) GROUP BY share)
      SELECT share, threshold, calls, conversions,
             {rnd("(1.0 * conversions / calls)", 4)} AS precision,
             {rnd("(1.0 * conversions / positives)", 4)} AS recall,
             {rnd("((1.0 * conversions / calls) / (1.0 * positives / total))", 4)} AS lift,
             CAST(calls * 5.0 AS DOUBLE) AS cost, CAST(conversions * 500.0 AS DOUBLE) AS revenue,
             {rnd("((conversions * 500.0) / (calls * 5.0))", 2)} AS roi
      FROM f""",
}
