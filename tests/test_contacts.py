import pytest
from pyspark.sql import functions as F

from convlens.sources import contacts as S
from convlens.sources.contacts import contacts


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_sliced_history_equals_the_plain_window(spark, kind):
    """One customer holds a third of the orders, and one date a third of those."""
    t = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("o_custkey"),
        F.expr("int(pmod(hash(id), 1000000))").cast("long").alias("k"),
        "id",
    )
    t = t.select(
        "o_custkey",
        (F.col("k") * 10_000 + F.col("id")).alias("o_orderkey"),
        F.when(F.col("id") % 9 == 0, F.lit("2000-01-01"))
        .otherwise(F.expr("string(date_add(date'1999-06-01', int(pmod(k, 500))))"))
        .cast(kind)
        .alias("o_orderdate"),
        F.substring(F.lit("FOP"), F.pmod("k", F.lit(3)).cast("int") + 1, F.lit(1)).alias(
            "o_orderstatus"
        ),
    ).cache()
    key = ["o_orderkey"]
    plain = S._plain_history(t).orderBy(*key).collect()
    split = S.with_history(t, share=0.01, min_rows=50, rows_per_slice=70)
    columns = S._plain_history(t).columns
    assert sorted(split.columns) == sorted(columns)
    assert split.select(*columns).orderBy(*key).collect() == plain


def test_contacts_count_and_history_columns(spark, small_dir):
    t = contacts(spark, small_dir)
    assert t.count() == spark.read.parquet(f"{small_dir}/orders.parquet").count()
    bad = t.where(
        (F.col("campaign") != F.col("previous") + 1)
        | ((F.col("previously_contacted") == 0) != (F.col("poutcome") == "nonexistent"))
        | ((F.col("previously_contacted") == 0) & (F.col("pdays") != S.NO_HISTORY))
    )
    assert bad.count() == 0


def test_history_is_not_computed_where_it_is_not_read(spark, small_dir):
    plan = contacts(spark, small_dir).groupBy("segment").count()
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()
