from pyspark.sql import functions as F

from convlens.functions.columns import tier
from convlens.operators import conversion as C

# Published counts (label, size, positives) and the figures derived from them.
BY_JOB = [
    ("student", 875, 275, 31.43, 1, 2.13, "HIGH"),
    ("retired", 1718, 434, 25.26, 2, 4.17, "HIGH"),
    ("unemployed", 1014, 144, 14.2, 3, 2.46, "AVERAGE"),
    ("admin.", 10418, 1351, 12.97, 4, 25.3, "AVERAGE"),
    ("management", 2923, 328, 11.22, 5, 7.1, "AVERAGE"),
    ("unknown", 330, 37, 11.21, 6, 0.8, "AVERAGE"),
    ("technician", 6739, 730, 10.83, 7, 16.37, "AVERAGE"),
    ("self-employed", 1421, 149, 10.49, 8, 3.45, "AVERAGE"),
    ("housemaid", 1060, 106, 10.0, 9, 2.57, "AVERAGE"),
    ("entrepreneur", 1456, 124, 8.52, 10, 3.54, "LOW"),
    ("services", 3967, 323, 8.14, 11, 9.64, "LOW"),
    ("blue-collar", 9251, 638, 6.9, 12, 22.47, "LOW"),
]
BY_PRIOR_OUTCOME = [
    ("success 1", 1373, 894, 65.11, 3.33, 1.88),
    ("failure 1", 142, 73, 51.41, 0.34, 1.49),
    ("failure 0", 4110, 532, 12.94, 9.98, 0.37),
    ("nonexistent 0", 35547, 3140, 8.83, 86.34, 0.26),
]
BY_COUNT = [
    (1, 17634, 2299, 42.8),
    (2, 10567, 1211, 68.5),
    (3, 5339, 574, 81.5),
    (4, 2649, 249, 87.9),
    (5, 1599, 120, 91.8),
    (6, 979, 75, 94.2),
    (7, 629, 38, 95.7),
    (8, 400, 17, 96.7),
    (9, 283, 17, 97.3),
    (10, 224, 12, 97.9),
    (11, 177, 12, 98.3),
    (12, 125, 3, 98.6),
    (13, 92, 4, 98.8),
    (14, 475, 8, 100.0),
]
BY_DAY = [
    ("thu", 8618, 1044, 100.0),
    ("tue", 8084, 953, 75.0),
    ("wed", 8134, 949, 50.0),
    ("fri", 7825, 846, 25.0),
    ("mon", 8511, 847, 0.0),
]


def _rows_of(spark, counts, kind="string"):
    """Label rows with the given group sizes, made by Spark from the counts."""
    t = spark.createDataFrame([(k, n, h) for k, n, h, *_ in counts], f"g {kind}, n int, h int")
    t = t.select("g", "h", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    return t.select("g", (F.col("i") <= F.col("h")).cast("int").alias("y_encoded"))


def test_published_figures_by_job(spark):
    res = C.with_share(C.with_rank(C.conversion(_rows_of(spark, BY_JOB), ["g"])))
    rate = F.col("conv_rate_pct")
    res = res.withColumn("tier", tier([(rate >= 20, "HIGH"), (rate >= 10, "AVERAGE")], "LOW"))
    got = [
        (r["g"], r["total_clients"], r["subscribed"], r["conv_rate_pct"], r["rank_by_conv"],
         r["pct_of_dataset"], r["tier"])
        for r in res.orderBy("rank_by_conv").collect()
    ]
    assert got == BY_JOB


def test_published_overview(spark):
    r = C.overview(_rows_of(spark, BY_JOB)).first()
    assert tuple(r) == (41172, 4639, 36533, 11.27, 88.73, 7.9)


def test_published_index_by_prior_outcome(spark):
    res = C.vs_mean(C.with_share(C.conversion(_rows_of(spark, BY_PRIOR_OUTCOME), ["g"])), "index")
    got = {r["g"]: (r["conv_rate_pct"], r["pct_of_dataset"], r["conv_index"]) for r in res.collect()}
    assert got == {g: rest for g, _, _, *rest in BY_PRIOR_OUTCOME for rest in [tuple(rest)]}


def test_published_reach_by_contact_count_for_any_slicing(spark):
    res = C.conversion(_rows_of(spark, BY_COUNT, "int"), ["g"])
    for per_slice in (3, 1_000_000):
        out = C.with_reach(res, "g", name="reach", values_per_slice=per_slice)
        assert {r["g"]: r["reach"] for r in out.collect()} == {g: x for g, _, _, x in BY_COUNT}


def test_published_percent_rank_by_day(spark):
    res = C.with_percent_rank(C.conversion(_rows_of(spark, BY_DAY), ["g"]))
    assert {r["g"]: r["conv_percent_rank"] for r in res.collect()} == {
        g: x for g, _, _, x in BY_DAY
    }


def test_equal_rates_share_a_rank_and_extremes_are_stable(spark):
    t = _rows_of(spark, [("b", 10, 5), ("a", 10, 5), ("c", 10, 1)])
    res = C.with_rank(C.conversion(t, ["g"]))
    assert {r["g"]: r["rank_by_conv"] for r in res.collect()} == {"a": 1, "b": 1, "c": 3}
    assert tuple(C.extremes(res, "g").first()) == ("a", 50.0, "c", 10.0)
    ends = C.top_bottom(res.drop("rank_by_conv"), "g", 1).collect()
    assert [(r["end"], r["g"]) for r in ends] == [("top", "a"), ("bottom", "c")]


def test_no_rows_give_no_groups_and_an_empty_overview(spark):
    none = _rows_of(spark, BY_DAY).where("g = 'sun'")
    assert C.conversion(none, ["g"]).count() == 0
    assert C.multi_conversion(none, ["g"]).count() == 0
    r = C.overview(none).first()
    assert (r[0], r[1], r[3], r[5]) == (0, 0, None, None)
    rates = C.subset_rates(none, {"all": F.lit(True)}).first()
    assert tuple(rates) == ("all", 0, 0, None)


def test_missing_labels_of_a_dimension_form_a_group(spark):
    t = spark.createDataFrame([(None, 1), (None, 0), ("a", 1)], "g string, y_encoded int")
    got = {r["category"]: r["conv_rate_pct"] for r in C.multi_conversion(t, ["g"]).collect()}
    assert got == {None: 50.0, "a": 100.0}
    cube = C.kpi_cube(t, ["g"]).collect()
    assert sorted((r["filter_id"], r["total_clients"]) for r in cube) == [(0, 1), (0, 2), (1, 3)]


def test_small_groups_are_left_out_of_the_share(spark):
    t = _rows_of(spark, [("a", 30, 3), ("b", 70, 7), ("c", 5, 5)])
    res = C.with_share(C.conversion(t, ["g"], min_n=30))
    assert {r["g"]: r["pct_of_dataset"] for r in res.collect()} == {"a": 30.0, "b": 70.0}


def test_levels_in_a_fixed_order(spark):
    res = C.conversion(_rows_of(spark, BY_DAY), ["g"])
    out = C.order_levels(res, "g", ["mon", "tue", "sun", "wed"])
    assert [r["g"] for r in out.collect()] == ["mon", "tue", "wed"]


def test_lookup_form_equals_the_joined_form(spark):
    facts = spark.range(0, 1000).select(
        F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 7).alias("k"),
        (F.col("id") % 3 == 0).cast("int").alias("y_encoded"),
    )
    parity = [(i, "even" if i % 2 == 0 else "odd") for i in range(6)]
    lookup = spark.createDataFrame(parity, "k long, g string")
    a = C.conversion_by_lookup(facts, lookup, "k", ["g"]).orderBy("g").collect()
    b = C.conversion(facts.join(lookup, "k"), ["g"]).orderBy("g").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]


def test_cross_table_has_a_column_for_an_absent_level(spark):
    t = spark.createDataFrame([("jan", "mon", 1), ("jan", "mon", 0)], "m string, d string, y_encoded int")
    r = C.cross_table(t, "m", "d", ["mon", "tue"]).first()
    assert (r["mon_n"], r["mon_rate"], r["tue_n"], r["tue_rate"]) == (2, 50.0, None, None)
