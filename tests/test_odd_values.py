"""Values that earlier fixtures did not hold: bad text in removed rows, NaN, repeated answers."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.operators import cleaning, modelling, routing, scoring, splitting, statistics
from convlens.sources.tables import publish

NAN, INF = float("nan"), float("inf")


def test_audit_counts_past_values_of_removed_rows(spark):
    rows = [(2 + i % 5, str(i)) for i in range(50)] + [(0, "bad")]
    t = spark.createDataFrame(rows, "quantity int, price string")
    cast = cleaning.Rule("Cast price", "as int", "price", change=lambda d: d.withColumn("price", F.col("price").cast("int")))
    rules = [
        cleaning.keep_rows("Positive", F.col("quantity") > 1, "quantity"),
        cast,
        cleaning.winsorise("price", 0.9),
        cleaning.keep_rows("Priced", F.col("price") >= 20, "price"),
    ]
    table, audit = cleaning.clean(t, rules)
    steps = [(r["rows_before"], r["rows_after"]) for r in audit.orderBy("step").collect()]
    assert table.count() == 30 and steps == [(51, 50), (50, 50), (50, 50), (50, 30)]


def test_answers_of_other_rules_and_repeated_answers(spark):
    q = spark.createDataFrame([("my bill",), ("other",)], "q string")
    routed = routing.route(q, "q", [("billing", ["bill"])])
    answers = spark.createDataFrame([("billing", "pay"), ("default", "ask")], "category string, answer string")
    got = {r["q"]: r["answer"] for r in routing.answer(routed, answers, "q").collect()}
    assert got == {"my bill": "pay", "other": "ask"}
    with pytest.raises(Exception, match="more than one answer for billing"):
        routing.answer(routed, answers.unionByName(answers), "q").collect()


def test_correlations_leave_out_what_is_no_number(spark):
    rows = [(float(i), float(i * i), 2.0 * i) for i in range(9)] + [(NAN, 1.0, 2.0), (3.0, INF, 6.0), (None, 1.0, 5.0)]
    t = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in statistics.corr_pairs(t, [("a", "b"), ("a", "c"), ("b", "c")]).collect()}
    pdf = t.toPandas().replace([INF], NAN).corr()
    assert all(got[p] == pytest.approx(pdf.loc[p[0], p[1]], abs=1e-5) for p in got) and len(got) == 3


def test_everything_can_go_to_the_test_rows(spark):
    t = spark.range(1000).withColumn("y", F.col("id") % 2)
    assert splitting.stratified_split(t, "y", "id", 1.0).where("split = 'train'").count() == 0
    assert splitting.stratified_split(t, "y", "id", 0.0).where("split = 'test'").count() == 0


def test_many_classes_are_refused_before_they_are_collected(spark):
    t = spark.range(500).withColumn("y", F.col("id"))
    with pytest.raises(ValueError, match="few classes"):
        splitting.with_class_weights(t, "y")
    with pytest.raises(ValueError, match="few classes"):
        splitting.stratified_split(t, "y", "id", exact=True)


def test_publishing_counts_missing_values(spark):
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.DoubleType())])
    t = spark.createDataFrame([(1, 1.0), (None, 2.0)], "id long, v double")
    with pytest.raises(ValueError, match="id \\(1 rows\\)"):
        publish(t, "with_missing", schema)
    assert publish(t.where("id = 1"), "without_missing", schema).count() == 1


def test_scores_that_are_no_number_are_left_out(spark):
    rows = [(1, 0.9), (0, 0.1), (1, 0.8), (0, 0.3), (0, NAN), (0, None)]
    t = spark.createDataFrame(rows, "y int, score double")
    assert scoring.roc_auc(t, "y", "score").first()["roc_auc"] == 1.0


def test_dedup_settles_ties_by_the_other_columns(spark):
    rows = [(1, 5, x) for x in range(40)]
    t = spark.createDataFrame(rows, "k int, o int, x int").repartition(7)
    assert cleaning.dedup(t, ["k"], [F.col("o")]).first()["x"] == 0


def test_all_values_outside_the_domain_are_listed(spark):
    t = spark.range(60).select(F.concat(F.lit("v"), F.col("id") % 30).alias("y")).unionByName(spark.createDataFrame([(None,), ("yes",)], "y string"))
    got = {r["value"]: r["rows"] for r in cleaning.domain_violations(t, "y", ["yes"]).collect()}
    assert got == {**{f"v{i}": 2 for i in range(30)}, None: 1}
    with pytest.raises(ValueError, match="31 in 61 rows"):
        cleaning.assert_domain(t, "y", ["yes"])


def test_a_forest_does_not_follow_the_layout_of_its_rows(spark):
    t = spark.range(800).select(
        F.col("id").alias("id"), (F.col("id") * 7 % 31).cast("double").alias("a"), (F.col("id") * 13 % 17).cast("double").alias("b")
    )
    t = t.withColumn("y", (F.col("a") + F.col("b") > 25).cast("int"))
    fit = lambda rows: modelling.feature_importance(modelling.random_forest(5, 4).fit(rows, ["a", "b"], "y"), rows, 2).collect()
    assert fit(t.repartition(3)) == fit(t.repartition(11).orderBy(F.col("id").desc()))
