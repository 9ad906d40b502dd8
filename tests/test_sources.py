import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.columns import flag, norm_text
from convlens.sources import staging, tables
from convlens.sources.tables import categorical_columns, numeric_columns

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("credit_default", T.StringType(), True)]
)


def test_csv_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, "a b"), (2, "c,d")], "id long, `x.y` string")
    path = str(tmp_path / "t.csv")
    tables.write_table(t, path, "csv")
    typed = tables.read_table(spark, path, t.schema)
    assert sorted(map(tuple, typed.collect())) == [(1, "a b"), (2, "c,d")]
    assert tables.read_table(spark, path).columns == ["id", "x.y"]
    tables.write_table(t, str(tmp_path / "t.json"), "json")
    tables.write_table(t, str(tmp_path / "result"))
    assert tables.load_result(spark, str(tmp_path), "result").count() == 2


def test_contract(spark, caplog):
    t = spark.createDataFrame([(1, "a")], "id long, credit_default string")
    assert tables.check_contract(t, ["id", "credit_default"], expected_rows=5) is t
    assert "1 rows instead of 5" in caplog.text
    tables.check_contract(t, SCHEMA)
    with pytest.raises(ValueError, match="expected 1 columns"):
        tables.check_contract(t, ["id"])
    with pytest.raises(ValueError, match="missing columns"):
        tables.check_contract(t, ["id", "other"])
    with pytest.raises(ValueError, match="another type"):
        tables.check_contract(t.withColumn("id", F.lit("1")), SCHEMA)
    with pytest.raises(ValueError, match="empty"):
        tables.check_contract(t.limit(0), SCHEMA)


def test_publish_renames_orders_and_refuses_nulls(spark):
    t = spark.createDataFrame([("no", 1, 9)], "default string, id int, extra int")
    out = tables.publish(t, "published_contacts", SCHEMA, {"default": "credit_default"})
    assert out.columns == ["id", "credit_default"]
    assert tuple(spark.sql("SELECT * FROM published_contacts").first()) == (1, "no")
    bad = spark.createDataFrame([("no", None)], "default string, id int")
    with pytest.raises(Exception, match="NULL in column id"):
        tables.publish(bad, "published_contacts", SCHEMA, {"default": "credit_default"}).collect()


def test_staging_uses_the_shared_folder(spark):
    folder = staging.shared_folder(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured
    t = staging.stage(spark.range(5), "numbers")
    assert t.count() == 5
    assert all(f"{folder}/numbers-" in f for f in t.inputFiles())


def test_columns_by_type(spark):
    t = spark.createDataFrame([(1, "a", 1.0, True)], "i int, s string, d double, b boolean")
    assert numeric_columns(t) == ["i", "d"]
    assert categorical_columns(t) == ["s", "b"]


def test_narrow_operators_run_on_a_stream(spark, tmp_path):
    t = spark.createDataFrame([(" A ", 1), ("b", 0)], "s string, n int")
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    out = stream.select(norm_text("s").alias("s"), flag(F.col("n") == 1).alias("f"))
    query = (
        out.writeStream.format("memory").queryName("narrow_out")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("narrow_out").collect())) == [("a", 1), ("b", 0)]
    finally:
        query.stop()
