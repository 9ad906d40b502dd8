import json

import pytest
from pyspark.sql import functions as F

from convlens.operators import conversion as C
from convlens.operators import insights as I
from convlens.operators import routing as R

# Questions a user of the report asks, and the category each belongs to.
QUESTIONS = [
    ("Which customers convert best, by job?", "customer_groups"),
    ("Which campaign characteristics go with better outcomes?", "campaign"),
    ("Name each major finding of the analysis", "recommendations"),
    ("What should a manager look at first?", "recommendations"),
    ("How did the random forest do?", "model"),
    ("What is most predictive of a sale?", "features"),
    ("Which months are good for calling?", "campaign"),
    ("What is the effect of the previous outcome?", "poutcome"),
    ("Tell me the limitations of the previous model", "model_limitations"),
    ("Give me an executive summary with every feature", "recommendations"),
    ("What is the average?", "customer_groups"),
    ("Hello there", "default"),
    ("", "default"),
    (None, "default"),
]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(i, q) for i, (q, _) in enumerate(QUESTIONS)], "i int, q string")


def test_questions_go_to_the_first_matching_category(questions):
    got = [r["category"] for r in R.route(questions, "q").orderBy("i").collect()]
    assert got == [c for _, c in QUESTIONS]


def test_answers_fall_back_and_blank_questions_are_errors(questions):
    answers = R.answers_table(questions, {"campaign": "calls", "default": "other"})
    t = questions.unionByName(questions.sparkSession.createDataFrame([(99, " \n\t ")], "i int, q string"))
    rows = {r["i"]: r for r in R.answer(R.route(t, "q"), answers, "q").collect()}
    assert (rows[1]["answer"], rows[1]["source"]) == ("calls", "fallback")
    assert rows[4]["answer"] == "other"
    for i in (12, 13, 99):
        assert (rows[i]["answer"], rows[i]["source"]) == ("Please provide a question.", "error")
    counts = {r["category"]: r["questions"] for r in R.route_summary(R.route(t, "q")).collect()}
    assert counts["recommendations"] == 3


@pytest.fixture(scope="module")
def t(spark):
    rows = [("a", 1)] * 3 + [("a", 0)] + [("b", 1)] + [("b", 0)] * 5
    return spark.createDataFrame(rows, "g string, y_encoded int")


def test_insights_compare_with_the_whole(t):
    r = I.insights(C.multi_conversion(t, ["g"]), C.overview(t)).first()
    assert (r["best"], r["best_rate"], r["best_lift"], r["base_rate"]) == ("a", 75.0, 1.88, 40.0)
    assert r["headline"] == "g: a converts at 75.0%, 1.9x the overall 40.0%"


def test_findings_and_facts(t):
    res = C.conversion(t, ["g"])
    assert I.finding("?", I.extremes_text(res, "g")).first()["evidence"] == (
        "Highest: a (75.0%), lowest: b (16.7%)"
    )
    got = {(r["key"], r["metric"]): r["value"] for r in I.facts({"s": (res, "g")}).collect()}
    assert got["a", "subscribed"] == 3.0 and len(got) == 6


def test_bundle_is_valid_json_without_nan(spark, t, tmp_path):
    odd = spark.createDataFrame([("x", float("nan")), ("y", float("inf")), ("z", 1.5)], "k string, v double")
    many = spark.range(5000).select((F.col("id") % 700).alias("n")).repartition(13)
    parts = {"by_g": C.conversion(t, ["g"]), "odd": odd, "none": odd.limit(0), "many": many}
    assert I.bundle({k: parts[k] for k in ("by_g", "odd", "none")}).count() == 5
    lines = I.document_lines(parts).collect()
    assert len({r["position"] for r in lines}) == len(lines)
    document = json.loads("".join(r["line"] for r in sorted(lines, key=lambda r: r["position"])))
    assert list(document) == list(parts)
    assert document["odd"] == [{"k": "x", "v": None}, {"k": "y", "v": None}, {"k": "z", "v": 1.5}]
    assert len(document["by_g"]) == 2 and document["none"] == [] and len(document["many"]) == 5000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        I.write_document(parts, str(tmp_path / "bundle"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "bundle").glob("part-*"))
    assert len(files) > 1 and json.loads("".join(f.read_text() for f in files)) == document


def test_reconcile_reports_what_differs(spark):
    a = spark.createDataFrame([("n", 10.0), ("r", 1.234), ("only_a", 1.0)], "check string, value double")
    b = spark.createDataFrame([("n", 10.0), ("r", 1.25), ("only_b", 1.0)], "check string, value double")
    got = {r["check"]: r["passed"] for r in I.reconcile(a, b).collect()}
    assert got == {"n": "PASS", "r": "FAIL", "only_a": "FAIL", "only_b": "FAIL"}


def test_tolerances_of_single_checks(spark):
    a = spark.createDataFrame([("n", 10.0), ("m", 1.0), ("r", 5.0)], "check string, value double")
    b = spark.createDataFrame([("n", 10.005), ("m", 1.04), ("r", 5.005)], "check string, value double")
    got = {r["check"]: r["passed"] for r in I.reconcile(a, b, 0.01, {"n": 0.0, "m": 0.05}).collect()}
    assert got == {"n": "FAIL", "m": "PASS", "r": "PASS"}


def test_tiers_are_rolled_up_from_sums(t):
    res = C.conversion(t, ["g"]).withColumn("tier", F.lit("all"))
    r = I.tier_summary(res, "tier").first()
    assert (r["groups"], r["total_clients"], r["subscribed"], r["conv_rate_pct"]) == (2, 10, 4, 40.0)
