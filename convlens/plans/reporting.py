"""Findings, insights, facts, bundle, reconciliation and question routing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.columns import count_where, flag, percent, round_half_up
from convlens.operators import conversion as C
from convlens.operators import insights as I
from convlens.operators import modelling as M
from convlens.operators import routing as R
from convlens.operators.percentiles import median_by
from convlens.operators.profiling import duplicate_groups
from convlens.operators.statistics import corr_pairs
from convlens.operators import splitting as SP
from convlens.operators import statistics as ST
from convlens.operators.conversion import N, RATE, extremes
from convlens.plans import learning
from convlens.plans.learning import _model_input
from convlens.plans import segments as G
from convlens.plans.segments import MEASURES, WITH, _multi, contact_zone, pct, rnd
from convlens.plans.segments import ORACLE as SEGMENT_SQL
from convlens.sources.contacts import contacts, contacts_once, read
from convlens.sources.tables import publish

DIMENSIONS = ["segment", "region", "priority", "contact", "poutcome"]

# The published contact table: name, type, required.
CONTACT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("customer_segment", T.StringType(), False),
        T.StructField("region", T.StringType(), False),
        T.StructField("contact", T.StringType(), False),
        T.StructField("poutcome", T.StringType(), False),
        T.StructField("age", T.IntegerType(), False),
        T.StructField("duration", T.IntegerType(), False),
        T.StructField("campaign", T.IntegerType(), False),
        T.StructField("y_encoded", T.IntegerType(), False),
    ]
)


# Findings that name the best and the worst group of a dimension.
GROUP_QUESTIONS = {
    "Does the priority matter?": "priority",
    "Which channel converts best?": "contact",
    "Which weekdays convert best?": "day_of_week",
    "Do regions differ?": "region",
}


def findings(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts_once(spark, folder)
    pair = lambda a, b: F.format_string(a, *b)
    overall = C.overview(t).select(
        pair(
            "no=%d (%.2f%%), yes=%d (%.2f%%)",
            ["total_not_subscribed", "non_subscription_rate_pct", "total_subscribed",
             "subscription_rate_pct"],
        ).alias("evidence")
    )
    medians = median_by(t, ["y"], "age").groupBy().pivot("y", ["yes", "no"]).agg(F.max("median"))
    medians = medians.select(
        pair("median age: yes %.0f, no %.0f",
             [F.floor(F.col("yes") + 0.5).cast("double"), F.floor(F.col("no") + 0.5).cast("double")]
             ).alias("evidence")
    )
    subsets = C.subset_rates(
        t, {"first": F.col("campaign") == 1, "success": F.col("poutcome") == "success"}, digits=1
    )
    subsets = subsets.groupBy().pivot("subset", ["first", "success"]).agg(F.max(C.RATE)).select(
        pair("first contact %.1f%%, prior success %.1f%%", ["first", "success"]).alias("evidence")
    )
    r = corr_pairs(t, [("duration", "price")], 3).select(
        pair("duration/price r=%.3f", ["r"]).alias("evidence")
    )
    return C.stack_results(
        I.finding("What is the overall rate?", overall),
        I.finding("Which segments convert best?",
                  I.extremes_text(C.conversion(t, ["segment"]), "segment")),
        I.finding("Does age matter?", medians),
        I.finding("Do contact count and history matter?", subsets),
        I.finding("Which months convert best?",
                  I.extremes_text(C.conversion(t, ["month"]), "month")),
        I.finding("Are features collinear?", r),
        *[
            I.finding(question, I.extremes_text(C.conversion(t, [dim]), dim))
            for question, dim in GROUP_QUESTIONS.items()
        ],
    )


def insights(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts_once(spark, folder)
    return I.insights(C.multi_conversion(t, [*DIMENSIONS, "month"]), C.overview(t))


#: Numeric columns whose correlation with the label is reported; the duration is known too late.
REPORTED = ["age", "campaign", "previous", "pdays", "price", "balance"]


def _figures(t: DataFrame, evaluation: DataFrame) -> DataFrame:
    """One row of all numbers and names that the cards and answers state."""
    one = lambda p: percent(count_where(p & (F.col("y_encoded") == 1)), count_where(p), 1)
    share = lambda p: percent(count_where(p), F.count(F.lit(1)), 1)
    success, low = F.col("poutcome") == "success", F.col("balance") < 2000.0
    test = SP.hash_number("id", SP.SEED, digits=8) < F.lit(int(0.2 * 16**8))
    row = t.agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("y_encoded") == 1).alias("sold"),
        one(F.lit(True)).alias("rate"), one(success).alias("success"),
        count_where(success).alias("success_n"),
        one(F.col("campaign") == 1).alias("first"), one(F.col("campaign") > 6).alias("late"),
        share(F.col("campaign") > 6).alias("late_share"),
        one(low).alias("low"), one(~low).alias("high"), share(low).alias("low_share"),
        count_where(test).alias("held_out"),
    )

    def ends(dim: str) -> dict:
        res = C.conversion(t, [dim])
        row = extremes(res, dim).select(
            F.struct("best", round_half_up("best_rate", 1).alias("best_rate"), "worst", round_half_up("worst_rate", 1).alias("worst_rate")).alias("e")
        )
        return row.scalar()

    months = C.conversion(t, ["month"])
    busiest = months.agg(F.max_by(F.struct("month", N, round_half_up(RATE, 1).alias("rate")), F.struct(N, "month")).alias("m"))
    r = ST.target_corr(t, REPORTED, "y_encoded", 3).select("feature", "pearson_r", "abs_r")
    ranked = r.agg(F.array_sort(F.collect_list(F.struct((-F.col("abs_r")).alias("o"), "feature", F.col("pearson_r").alias("r")))).alias("c"))
    best = M.best_model(evaluation).select(F.struct("model", "f1", "roc_auc", "pr_auc", "precision", "recall").alias("b"))
    return row.select(
        "*", ends("segment").alias("segment"), ends("contact").alias("contact"), ends("month").alias("month"), ends("poutcome").alias("poutcome"),
        busiest.scalar().alias("busy"), ranked.scalar().alias("corr"), best.scalar().alias("model"),
        round_half_up((F.col("n") - F.col("sold")) / F.col("sold"), 1).alias("imbalance"),
    )


# Fixed formats: kind of insight or answer, its sentence, and the figures in it.
CARDS = [
    ("prior success", "Contacts with a prior success convert at %.1f%% (n=%d), overall %.1f%%", ["success", "success_n", "rate"]),
    ("contact count", "First contacts convert at %.1f%%, those beyond the sixth at %.1f%% (%.1f%% of all)", ["first", "late", "late_share"]),
    ("channel", "%s converts at %.1f%%, %s at %.1f%%", ["contact.best", "contact.best_rate", "contact.worst", "contact.worst_rate"]),
    ("timing", "%s has most contacts (%d) at %.1f%%; %s converts best at %.1f%%", ["busy.month", "busy.total_clients", "busy.rate", "month.best", "month.best_rate"]),
    ("segment", "%s converts at %.1f%%, %s at %.1f%%", ["segment.best", "segment.best_rate", "segment.worst", "segment.worst_rate"]),
    ("model", "%s: F1 %.4f, ROC-AUC %.4f, PR-AUC %.4f, recall %.4f", ["model.model", "model.f1", "model.roc_auc", "model.pr_auc", "model.recall"]),
    ("threshold", "Balances below 2000 (%.1f%% of all) convert at %.1f%%, others at %.1f%%", ["low_share", "low", "high"]),
]
ANSWERS = [
    ("conversion_rate", "%.1f%% of %d contacts subscribed, %.1f no for each yes", ["rate", "n", "imbalance"]),
    ("customer_groups", "Highest: %s (%.1f%%), lowest: %s (%.1f%%)", ["segment.best", "segment.best_rate", "segment.worst", "segment.worst_rate"]),
    ("campaign", "Months: %s (%.1f%%) to %s (%.1f%%); channels: %s (%.1f%%) to %s (%.1f%%); first contact %.1f%%",
     ["month.best", "month.best_rate", "month.worst", "month.worst_rate", "contact.best", "contact.best_rate", "contact.worst", "contact.worst_rate", "first"]),
    ("poutcome", "Highest: %s (%.1f%%), lowest: %s (%.1f%%)", ["poutcome.best", "poutcome.best_rate", "poutcome.worst", "poutcome.worst_rate"]),
    ("features", "Strongest correlations: %s %.3f, %s %.3f, %s %.3f", [f"corr[{i}].{f}" for i in range(3) for f in ("feature", "r")]),
    ("recommendations", "Call prior successes first (%.1f%%); use %s (%.1f%%); stop after 6 contacts (%.1f%% beyond); call in %s (%.1f%%); start with %s (%.1f%%)",
     ["success", "contact.best", "contact.best_rate", "late", "month.best", "month.best_rate", "segment.best", "segment.best_rate"]),
    ("model", "Best by F1: %s with F1 %.4f, ROC-AUC %.4f, PR-AUC %.4f, precision %.4f, recall %.4f",
     ["model.model", "model.f1", "model.roc_auc", "model.pr_auc", "model.precision", "model.recall"]),
    ("model_limitations", "The duration is left out, as it is known after the call only; %.1f no for each yes; the threshold of 0.5 is not tuned; measured on %d held-out contacts",
     ["imbalance", "held_out"]),
    (R.DEFAULT, "%d contacts; please ask about rates, groups, campaigns, prior outcomes, features, models or recommendations", ["n"]),
]


def _sentences(figures: DataFrame, entries: list, name: str, text: str) -> DataFrame:
    """One row per entry, from the one row of figures."""
    rows = F.array(*[F.struct(F.lit(kind).alias(name), F.format_string(spec, *[F.expr(c) for c in columns]).alias(text)) for kind, spec, columns in entries])
    return figures.select(F.inline(rows))


def insight_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Seven kinds of insight; the models are the two fixed scoring rules."""
    figures = _figures(contacts_once(spark, folder), learning.rule_eval(spark, folder))
    return _sentences(figures, CARDS, "kind", "insight")


def answers(t: DataFrame, evaluation: DataFrame) -> DataFrame:
    """category, answer: one computed answer per category of questions."""
    return _sentences(_figures(t, evaluation), ANSWERS, "category", "answer")


def all_answers(spark: SparkSession, folder: str) -> DataFrame:
    return answers(contacts_once(spark, folder), learning.rule_eval(spark, folder))


def zone_summary(spark: SparkSession, folder: str) -> DataFrame:
    res = C.conversion(contacts(spark, folder), {"contact_count": F.col("campaign")})
    return I.tier_summary(res.withColumn("contact_zone", contact_zone()), "contact_zone")


# Sections of the report: the result, the full key of its rows, and the query with its SQL.
SECTIONS = {
    "kpis": (G.kpi_result, "'all'", "headline_kpis"),
    "by_segment": (
        lambda t: G.segment_result(C.conversion(t, ["segment"])), "segment", "conv_by_segment"
    ),
    "by_priority": (G.priority_result, "priority", "conv_by_priority_ordinal"),
    "by_region": (G.region_result, "region", "conv_by_region_avgs"),
    "by_contact": (G.contact_result, "contact", "conv_by_contact"),
    "by_contact_count": (
        G.contact_count_result, "concat(contact_count, ' ', contact_zone)", "conv_by_contact_count"
    ),
    "by_prior_outcome": (
        G.prior_outcome_result, "concat(poutcome, ', ', previously_contacted)",
        "conv_by_prior_outcome",
    ),
    "by_duration_bucket": (G.duration_bucket_result, "duration_bucket", "value_buckets"),
    "by_duration_outcome": (G.duration_outcome_result, "outcome", "value_by_outcome"),
    "by_temporal": (G.temporal_result, "concat(time_dimension, '=', period)", "temporal"),
    "segments": (
        G.top_segment_result,
        "concat(age_band, ' ', job_tier, ', ', previously_contacted)", "top_segments",
    ),
}


def _results(t: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    return {name: (build(t), key) for name, (build, key, _) in SECTIONS.items()}


def _bundle_parts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The 15 sections: results, flags, both tables of model metrics and the insights."""
    t = contacts_once(spark, folder)
    parts = {name: res for name, (res, _) in _results(t).items()}
    dims = {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")}
    lines = read(spark, folder, "lineitem").withColumn("y_encoded", flag(F.col("l_quantity") >= 40))
    parts["by_flags"] = C.multi_conversion(lines, dims)
    parts["model_eval"], parts["model_cv"] = _model_results(spark, folder)
    parts["insights"] = I.insights(C.multi_conversion(t, [*DIMENSIONS, "month"]), C.overview(t))
    return parts


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all results, of all dimensions at once, of correlations and of the scoring rules."""
    t = contacts_once(spark, folder)
    more = {
        "by_dimension": (C.multi_conversion(t, [*DIMENSIONS, "month"]), "concat(dimension, '=', category)"),
        "correlations": (ST.target_corr(t, REPORTED, "y_encoded"), "feature"),
        "models": (learning.rule_card(spark, folder), "model"),
    }
    return I.facts(_results(t) | more)


def bundle(spark: SparkSession, folder: str) -> DataFrame:
    return I.bundle(_bundle_parts(spark, folder))


def bundle_document(spark: SparkSession, folder: str) -> DataFrame:
    """The bundle as the numbered lines of one JSON document."""
    return I.document_lines(_bundle_parts(spark, folder))


def bundle_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each section."""
    return bundle(spark, folder).groupBy("section").agg(F.count(F.lit(1)).alias("records"))


def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """The same figures through the DataFrame API and through SQL on the published view."""
    t = contacts_once(spark, folder)
    view = f"campaign_contacts_{uuid.uuid4().hex}"  # no view of the session is replaced
    publish(t, view, CONTACT_SCHEMA, {"segment": "customer_segment"})

    def rate(predicate):
        return percent(
            count_where(predicate & (F.col("y_encoded") == 1)), count_where(predicate)
        )

    figures = {
        "total rows": F.count(F.lit(1)),
        "subscription rate": rate(F.lit(True)),
        "building rate": rate(F.col("segment") == "BUILDING"),
        "cellular contacts": count_where(F.col("contact") == "cellular"),
        "prior success rate": rate(F.col("poutcome") == "success"),
        "mean duration": round_half_up(F.avg("duration"), 2),
        "zero durations": count_where(F.col("duration") == 0),
    }
    row = t.agg(*[c.cast("double").alias(f"f{i}") for i, c in enumerate(figures.values())])
    names = list(figures)
    a = row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("check"), F.col(f"f{i}").alias("value"))
                    for i, n in enumerate(names)
                ]
            )
        )
    )
    columns = [f.name for f in CONTACT_SCHEMA.fields if f.name != "id"]
    keys = {c: F.col("segment" if c == "customer_segment" else c) for c in columns}
    repeated = duplicate_groups(t, keys).agg(F.count(F.lit(1)).cast("double").alias("value"))
    a = a.unionByName(repeated.select(F.lit("duplicate rows").alias("check"), "value"))

    share = "floor(10000.0D * sum({0}) / nullif(count({0}), 0) + 0.5D) / 100.0D"
    queries = {
        "total rows": "count(*)",
        "subscription rate": share.format("y_encoded"),
        "building rate": share.format(
            "CASE WHEN customer_segment = 'BUILDING' THEN y_encoded END"),
        "cellular contacts": "count_if(contact = 'cellular')",
        "prior success rate": share.format("CASE WHEN poutcome = 'success' THEN y_encoded END"),
        "mean duration": "floor(avg(duration) * 100.0D + 0.5D) / 100.0D",
        "zero durations": "count_if(duration = 0)",
    }
    pairs = ", ".join(f"'{n}', CAST({q} AS DOUBLE)" for n, q in queries.items())
    key = ", ".join(columns)
    b = spark.sql(
        f"""SELECT stack({len(queries)}, {pairs}) AS (check, value) FROM {view}
        UNION ALL
        SELECT 'duplicate rows', CAST(count(*) AS DOUBLE) FROM (
          SELECT {key} FROM {view} GROUP BY {key} HAVING count(*) > 1)"""
    )
    spark.catalog.dropTempView(view)
    counts = ["total rows", "cellular contacts", "zero durations", "duplicate rows"]
    return I.reconcile(a, b, 0.01, dict.fromkeys(counts, 0.0) | {"mean duration": 0.05})


def route_questions(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "conversations").where(F.col("role") == "user")
    return R.route(t, "text").select("conv_id", "turn", "category")


def route_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn with an answer computed from the contact table."""
    q = read(spark, folder, "conversations").where(F.col("role") == "user")
    out = R.answer(R.route(q, "text"), all_answers(spark, folder), "text")
    return out.select("conv_id", "turn", "category", "answer", "source")


def route_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = R.route(read(spark, folder, "conversations"), "text")
    return R.route_summary(t, ["role", "category"])


def _model_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Held-out and cross-validated metrics of the baseline, the regression and the forest."""
    t, columns = _model_input(spark, folder)
    train, test = t.where("split = 'train'"), t.where("split = 'test'")
    models = [None, M.logistic_regression(), M.random_forest()]
    evaluation = M.compare(train, test, columns, "y_encoded", "id", models)
    return evaluation, M.cross_validate(train, columns, "y_encoded", "id", models)


def model_card(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out and cross-validated metrics of all models side by side."""
    return M.model_card(*_model_results(spark, folder))


QUERIES = {
    f.__name__: f
    for f in [
        findings,
        insights,
        insight_cards,
        all_answers,
        zone_summary,
        facts,
        bundle,
        bundle_document,
        bundle_sections,
        reconcile,
        route_questions,
        route_answers,
        route_summary,
        model_card,
    ]
}

# -- the same results in SQL --------------------------------------------------


def _extremes_text(dim: str) -> str:
    return (
        f"printf('Highest: %s (%.1f%%), lowest: %s (%.1f%%)', "
        f"first({dim} ORDER BY conv_rate_pct DESC, {dim}), {rnd('max(conv_rate_pct)', 1)}, "
        f"first({dim} ORDER BY conv_rate_pct, {dim}), {rnd('min(conv_rate_pct)', 1)})"
    )


def _extremes_from(dim: str, source: str = "contacts") -> str:
    return (
        f"(SELECT {_extremes_text(dim)} FROM (SELECT {dim}, {MEASURES} FROM {source} "
        f"GROUP BY {dim}))"
    )


def _rate(predicate: str, digits: int = 2) -> str:
    return pct(
        f"count(*) FILTER (WHERE {predicate} AND y_encoded = 1)",
        f"count(*) FILTER (WHERE {predicate})",
        digits,
    )


RATE_SQL = pct("sum(y_encoded)", "count(*)")
OTHER_RATE_SQL = pct("count(*) - sum(y_encoded)", "count(*)")


def _facts_of(section: str) -> str:
    """The numbers of a section's own SQL, turned into rows."""
    _, key, query = SECTIONS[section]
    return _facts_from(section, key, SEGMENT_SQL[query])


def _facts_from(section: str, key: str, sql: str) -> str:
    return f"""SELECT '{section}' AS section, key, metric, value
      FROM (SELECT {key} AS key, COLUMNS(lambda c: c IN ({METRICS}))::DOUBLE FROM ({sql}))
      UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE key)))"""


METRICS = ", ".join(
    f"'{m}'"
    for m in [
        "total_clients", "total_subscribed", "total_not_subscribed", "subscription_rate",
        "imbalance_ratio", "avg_call_duration_sec", "avg_campaign_contacts", "subscribed",
        "conv_rate_pct", "rank_by_conv", "pct_of_dataset", "priority_order", "diff_from_mean_pp",
        "avg_age", "avg_contacts", "contact_count", "pct_clients_reached_by_this_count",
        "previously_contacted", "avg_prior_contacts", "conv_index", "pct_of_calls", "clients",
        "avg_duration_sec", "avg_duration_min", "min_sec", "max_sec", "approx_median_sec",
        "avg_contacts_this_campaign", "total_calls", "conv_percent_rank", "segment_rank",
        "pearson_r", "abs_r", "tp", "fp", "fn", "tn", *M.METRICS,
        *[f"test_{m}_{part}" for m in M.METRICS for part in ("mean", "std")],
    ]
)

def _ends(dim: str) -> str:
    best = f"first({dim} ORDER BY conv_rate_pct DESC, {dim}) AS best, {rnd('max(conv_rate_pct)', 1)} AS best_rate"
    worst = f"first({dim} ORDER BY conv_rate_pct, {dim}) AS worst, {rnd('min(conv_rate_pct)', 1)} AS worst_rate"
    return f"{dim} AS (SELECT {best}, {worst} FROM (SELECT {dim}, {MEASURES} FROM contacts GROUP BY {dim}))"


_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rnd(f'(covar_pop({c}, y_encoded) / nullif(stddev_pop({c}) * stddev_pop(y_encoded), 0))', 3)} AS r FROM contacts"
    for c in REPORTED
)
FIGURES_SQL = f"""{", ".join(_ends(d) for d in ("segment", "contact", "month", "poutcome"))},
  busy AS (SELECT month, total_clients, {rnd("conv_rate_pct", 1)} AS rate
           FROM (SELECT month, {MEASURES} FROM contacts GROUP BY month)
           ORDER BY total_clients DESC, month DESC LIMIT 1),
  corr AS (SELECT list(struct_pack(feature := feature, r := r) ORDER BY abs(r) DESC, feature) AS c FROM ({_CORR})),
  model AS (SELECT * FROM ({learning.ORACLE["best_rule"]})),
  o AS (SELECT count(*) AS n, {pct("sum(y_encoded)", "count(*)", 1)} AS rate,
               {rnd("((count(*) - sum(y_encoded)) / sum(y_encoded))", 1)} AS imbalance,
               {_rate("poutcome = 'success'", 1)} AS success,
               count(*) FILTER (WHERE poutcome = 'success') AS success_n,
               {_rate("campaign = 1", 1)} AS first, {_rate("campaign > 6", 1)} AS late,
               {pct("count(*) FILTER (WHERE campaign > 6)", "count(*)", 1)} AS late_share,
               {_rate("balance < 2000", 1)} AS low, {_rate("NOT balance < 2000", 1)} AS high,
               {pct("count(*) FILTER (WHERE balance < 2000)", "count(*)", 1)} AS low_share,
               count(*) FILTER (WHERE {learning.HASH} < '33333333') AS held_out
        FROM contacts)"""


def _sentence_sql(entries: list, name: str, text: str) -> str:
    def value(c: str) -> str:
        if c.startswith("corr["):
            return f"corr.c[{int(c[5]) + 1}].{c.split('.')[1]}"
        return c if "." in c else f"o.{c}"

    return " UNION ALL ".join(
        f"SELECT '{kind}' AS {name}, printf('{spec}', {', '.join(value(c) for c in columns)}) AS {text} "
        "FROM o, segment, contact, month, poutcome, busy, corr, model"
        for kind, spec, columns in entries
    )


_ANSWERS = f"""{FIGURES_SQL}, a AS ({_sentence_sql(ANSWERS, "category", "answer")})"""


def _route_case(text: str) -> str:
    whens = " ".join(
        "WHEN "
        + " OR ".join(f"contains(lower({text}), '{w}')" for w in words)
        + f" THEN '{category}'"
        for category, words in R.RULES
    )
    return f"CASE {whens} ELSE '{R.DEFAULT}' END"


def _check(name: str, value: str) -> str:
    return f"SELECT '{name}' AS \"check\", CAST({value} AS DOUBLE) AS v FROM contacts"


ORACLE = {
    "findings": f"""{WITH}
      SELECT 'What is the overall rate?' AS question,
             printf('no=%d (%.2f%%), yes=%d (%.2f%%)', count(*) - sum(y_encoded),
                    {OTHER_RATE_SQL}, sum(y_encoded), {RATE_SQL}) AS evidence FROM contacts
      UNION ALL SELECT 'Which segments convert best?', {_extremes_from("segment")}
      UNION ALL SELECT 'Does age matter?', printf('median age: yes %.0f, no %.0f',
        floor(median(age) FILTER (WHERE y = 'yes') + 0.5),
        floor(median(age) FILTER (WHERE y = 'no') + 0.5)) FROM contacts
      UNION ALL SELECT 'Do contact count and history matter?',
        printf('first contact %.1f%%, prior success %.1f%%', {_rate("campaign = 1", 1)},
               {_rate("poutcome = 'success'", 1)}) FROM contacts
      UNION ALL SELECT 'Which months convert best?', {_extremes_from("month")}
      UNION ALL SELECT 'Are features collinear?', printf('duration/price r=%.3f',
        {rnd("(covar_pop(duration, price) / (stddev_pop(duration) * stddev_pop(price)))", 3)})
        FROM contacts"""
    + "".join(f" UNION ALL SELECT '{q}', {_extremes_from(dim)}" for q, dim in GROUP_QUESTIONS.items()),
    "insights": f"""{WITH}, g AS ({_multi("contacts", {x: x for x in [*DIMENSIONS, "month"]})}),
      o AS (SELECT {RATE_SQL} AS base_rate FROM contacts),
      e AS (SELECT dimension, first(category ORDER BY conv_rate_pct DESC, category) AS best,
                   max(conv_rate_pct) AS best_rate,
                   first(category ORDER BY conv_rate_pct, category) AS worst,
                   min(conv_rate_pct) AS worst_rate
            FROM g GROUP BY dimension),
      l AS (SELECT *, {rnd("(best_rate / base_rate)")} AS best_lift,
                   {rnd("(worst_rate / base_rate)")} AS worst_lift FROM e, o)
      SELECT dimension, best, best_rate, best_lift, worst, worst_rate, worst_lift, base_rate,
             printf('%s: %s converts at %.1f%%, %.1fx the overall %.1f%%', dimension, best,
                    {rnd("best_rate", 1)}, {rnd("best_lift", 1)}, {rnd("base_rate", 1)})
               AS headline,
             printf('Lowest is %s at %.1f%%, %.1fx the overall rate', worst,
                    {rnd("worst_rate", 1)}, {rnd("worst_lift", 1)}) AS detail,
             printf('%s %.2f%% against %s %.2f%%', best, best_rate, worst, worst_rate) AS evidence
      FROM l""",
    "zone_summary": f"""{WITH}, g AS (
        SELECT campaign, CASE WHEN campaign = 1 THEN 'FIRST CONTACT'
                 WHEN campaign BETWEEN 2 AND 3 THEN 'OPTIMAL ZONE'
                 WHEN campaign BETWEEN 4 AND 6 THEN 'DIMINISHING RETURNS'
                 ELSE 'OVER-CONTACTED' END AS contact_zone, y_encoded FROM contacts)
      SELECT contact_zone, count(DISTINCT campaign) AS groups, {MEASURES}
      FROM g GROUP BY contact_zone""",
    "insight_cards": f"{WITH}, {FIGURES_SQL} {_sentence_sql(CARDS, 'kind', 'insight')}",
    "all_answers": f"{WITH}, {_ANSWERS} SELECT * FROM a",
    "facts": " UNION ALL ".join(
        [_facts_of(section) for section in SECTIONS]
        + [
            _facts_from("by_dimension", "concat(dimension, '=', category)", WITH + _multi("contacts", {x: x for x in [*DIMENSIONS, "month"]})),
            _facts_from("correlations", "feature", WITH + " UNION ALL ".join(
                f"SELECT '{c}' AS feature, {learning._r(c, 'y_encoded')} AS pearson_r, abs({learning._r(c, 'y_encoded')}) AS abs_r FROM contacts"
                for c in REPORTED)),
            _facts_from("models", "model", learning.ORACLE["rule_card"]),
        ]
    ),
    "bundle_sections": " UNION ALL ".join(
        [f"SELECT '{name}' AS section, count(*) AS records FROM ({SEGMENT_SQL[query]})" for name, (_, _, query) in SECTIONS.items()]
        + [f"SELECT '{name}', 3" for name in ("model_eval", "model_cv")]
        + [f"SELECT 'insights', {len(DIMENSIONS) + 1}",
           "SELECT 'by_flags', count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) FROM lineitem"]
    ),
    "reconcile": f"""{WITH}, v AS (
        {" UNION ALL ".join([
            _check("total rows", "count(*)"),
            _check("subscription rate", RATE_SQL),
            _check("building rate", _rate("segment = 'BUILDING'")),
            _check("cellular contacts", "count(*) FILTER (WHERE contact = 'cellular')"),
            _check("prior success rate", _rate("poutcome = 'success'")),
            _check("mean duration", rnd("avg(duration)")),
            _check("zero durations", "count(*) FILTER (WHERE duration = 0)"),
        ])}
        UNION ALL SELECT 'duplicate rows', CAST(count(*) AS DOUBLE) FROM (
          SELECT count(*) FROM contacts
          GROUP BY segment, region, contact, poutcome, age, duration, campaign, y_encoded
          HAVING count(*) > 1))
      SELECT "check", v AS value_a, v AS value_b, 'PASS' AS passed FROM v""",
    "route_questions": f"""SELECT conv_id, turn, {_route_case("text")} AS category
      FROM conversations WHERE role = 'user'""",
    "route_answers": f"""{WITH}, {_ANSWERS},
      q AS (SELECT conv_id, turn, text, {_route_case("text")} AS category
            FROM conversations WHERE role = 'user')
      SELECT conv_id, turn, q.category,
             CASE WHEN trim(text) = '' THEN 'Please provide a question.'
                  ELSE coalesce(a.answer, (SELECT answer FROM a WHERE category = 'default')) END
               AS answer,
             CASE WHEN trim(text) = '' THEN 'error' ELSE 'fallback' END AS source
      FROM q LEFT JOIN a ON q.category = a.category""",
    "route_summary": f"""SELECT role, {_route_case("text")} AS category, count(*) AS questions
      FROM conversations GROUP BY 1, 2""",
}
