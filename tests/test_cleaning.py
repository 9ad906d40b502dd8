import pytest
from pyspark.sql import functions as F

from convlens.operators import cleaning as K
from convlens.operators import profiling as P


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(f" {c} ", i % 50, "Yes" if i % 4 == 0 else " no") for i, c in enumerate("aabbc" * 40)]
    rows += rows[:7]
    rows += [(" a ", 0, "no")] * 3
    return spark.createDataFrame(rows, "`job.name` string, n int, y string")


def rules():
    return [
        K.drop_exact_duplicates(),
        K.keep_rows("Drop n = 0", F.col("n") > 0, "n"),
        K.standardise("y"),
        K.keep_label(["job.name"]),
        K.winsorise("n", 0.9),
        K.rename({"job.name": "job", "absent": "x"}),
        K.keep_rows("Drop job c", F.col("job") != "c", "job"),
    ]


@pytest.mark.parametrize("staged", [True, False])
def test_audit_agrees_with_the_table(spark, raw, staged):
    cleaned, audit = K.clean(raw, rules(), staged=staged)
    steps = audit.orderBy("step").collect()
    pdf = raw.toPandas()
    once = pdf.drop_duplicates()
    assert [s["step"] for s in steps] == list(range(2, 9))
    assert steps[0]["rows_before"] == len(pdf)
    assert steps[0]["rows_after"] == len(once)
    assert steps[1]["rows_after"] == (once["n"] > 0).sum()
    assert steps[-1]["rows_after"] == cleaned.count()
    for a, b in zip(steps, steps[1:]):
        assert a["rows_after"] == b["rows_before"]
        assert a["rows_removed"] == a["rows_before"] - a["rows_after"]
    kept = once[once["n"] > 0]
    cap = int(kept["n"].quantile(0.9))
    assert steps[4]["notes"] == f"cap {cap}: {(kept['n'] > cap).sum()} values capped"
    assert cleaned.agg(F.max("n")).first()[0] == cap
    assert {r["job"] for r in cleaned.select("job").distinct().collect()} == {"a", "b"}
    assert cleaned.where("(y = 'yes') <> (y_encoded = 1)").count() == 0


def test_cleaning_twice_removes_nothing_more(spark, raw):
    once, _ = K.clean(raw, rules()[:1])
    twice, audit = K.clean(once, rules()[:1])
    assert audit.first()["rows_removed"] == 0
    assert once.exceptAll(twice).count() == 0


def test_dedup_by_key_keeps_the_first_in_order(spark):
    t = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, 1, "z")], "k int, o int, v string")
    got = {r["k"]: r["v"] for r in K.dedup(t, ["k"], ["o"]).collect()}
    assert got == {1: "y", 2: "z"}
    plan = K.dedup(t, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # limited before and after the shuffle


def test_domain_and_integrity_checks_name_the_problem(spark):
    t = spark.createDataFrame([("yes", 1), ("maybe", 2), (None, None)], "y string, n int")
    with pytest.raises(ValueError, match="maybe"):
        K.assert_domain(t, "y", ["yes", "no"])
    assert K.assert_domain(t.where("y = 'yes'"), "y", ["yes", "no"]).count() == 1
    with pytest.raises(ValueError, match=r"n > 0 \(1 rows\)"):
        K.assert_all(t, {"n > 0": F.col("n") > 0})
    with pytest.raises(ValueError, match="y is not null"):
        K.assert_all(t, K.no_nulls(t))


def test_ranges_are_flagged_not_removed(spark):
    t = spark.createDataFrame([(1,), (5,), (None,)], "n int")
    got = K.validate_ranges(t, {"low": ("n", 2, None), "any": ("n", 0, 9)}).collect()
    assert [tuple(r) for r in got] == [("low", 1, False), ("any", 0, True)]


def test_report_compares_before_and_after(spark, raw):
    cleaned, _ = K.clean(raw, [K.drop_exact_duplicates()])
    got = {r["measure"]: (r["before"], r["after"]) for r in K.clean_report(raw, cleaned, "y").collect()}
    assert got["exact duplicates"][0] > 0 and got["exact duplicates"][1] == 0
    assert got["rows"][0] - got["rows"][1] == got["exact duplicates"][0]


def test_quality_grades(spark):
    t = spark.range(0, 100).select(F.col("id").cast("int").alias("n"), F.lit(None).cast("int").alias("e"))
    checks = [P.Check(f"n < {k}", F.col("n") < k, "") for k in (1, 2, 11)]
    got = {r["check"]: (r["rows"], r["severity"]) for r in P.quality_summary(t, checks).collect()}
    assert got == {
        "Structural nulls": (100, "High"),
        "Exact duplicate rows": (0, "None"),
        "n < 1": (1, "Low"),
        "n < 2": (2, "Medium"),
        "n < 11": (11, "High"),
    }


def test_dictionary_of_awkward_columns(spark):
    t = spark.createDataFrame(
        [("b", None, 1.0), ("a", None, 1.0), (None, None, 3.0)], "`x.y` string, e int, d double"
    )
    got = {r["column"]: r for r in P.data_dictionary(t, unknown_in=["x.y"], unknown="a").collect()}
    assert got["x.y"]["sample_values"] == "a, b"
    assert got["x.y"]["has_unknown_label"] == "YES"
    assert (got["e"]["n_unique"], got["e"]["null_pct"], got["e"]["mean"]) == (0, 100.0, None)
    assert got["d"]["std"] == pytest.approx(1.1547)
    near = {r["column"]: r["n_unique"] for r in P.data_dictionary(t, approximate=True).collect()}
    assert near == {"x.y": 2, "e": 0, "d": 2}
    assert P.schema_table(t).where("kind = 'numeric'").count() == 2
