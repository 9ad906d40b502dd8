import pytest
from pyspark.sql import types as T

from convlens.sources import quarantine as Q

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("a.b", T.DoubleType(), True),
        T.StructField("s", T.StringType(), False),
    ]
)
CONTRACT = Q.Contract(SCHEMA, {"a.b above 9": "`a.b` <= 9"}, ["id"])
LINES = r"""id,a.b,s
1,2.5,"x, \"y\" z"
2,zehn,x
3,,x
4,5,
5,10,
6,1,z
6,1,z
,1,z
,2,z
7,1,x,more
8,1
"""


def _file(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text(text)
    return str(path)


def _reasons(rows):
    return sorted((r["id"] or 0, tuple(sorted(r[Q.REASONS]))) for r in rows.collect())


def test_every_reason_of_every_row(spark, tmp_path):
    rows = Q.judged(Q.read_csv(spark, _file(tmp_path, LINES), SCHEMA), CONTRACT)
    malformed = ("malformed",)
    assert _reasons(rows) == [
        (0, ("missing id",)), (0, ("missing id",)), (1, ()), (2, malformed), (3, ()), (4, ("missing s",)),
        (5, ("a.b above 9", "missing s")), (6, ("repeated key",)), (6, ("repeated key",)), (7, malformed), (8, malformed),
    ]
    assert Q.accepted(rows, CONTRACT).columns == ["id", "a.b", "s"]
    texts = {r["id"]: r[Q.RECORD] for r in Q.rejected(rows).collect() if r[Q.RECORD]}
    assert texts == {2: "2,zehn,x", 7: "7,1,x,more", 8: "8,1"}
    counts = {r["reason"]: r["rows"] for r in Q.report(rows).collect()}
    assert counts == {"accepted": 2, "rejected": 9, "malformed": 3, "missing id": 2, "missing s": 2, "a.b above 9": 1, "repeated key": 2}


def test_load_writes_both_parts(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert Q.load(spark, _file(tmp_path, LINES), CONTRACT, folder).count() == 7
    assert spark.read.parquet(f"{folder}/accepted").count() == 2
    assert spark.read.parquet(f"{folder}/rejected").count() == 9


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = _file(tmp_path, 'id,a.b,s\n1,2,"x\ny"\n2,3,z\n')
    rows = Q.judged(Q.read_csv(spark, path, SCHEMA, multi_line=True), CONTRACT)
    assert sorted(r["s"] for r in Q.accepted(rows, CONTRACT).collect()) == ["x\ny", "z"]


def test_empty_files_and_plain_tables(spark, tmp_path):
    rows = Q.judged(Q.read_csv(spark, _file(tmp_path, "id,a.b,s\n"), SCHEMA), CONTRACT)
    assert (rows.count(), Q.report(rows).count()) == (0, 0)
    plain = Q.judged(spark.createDataFrame([(1, 1.0, "x")], SCHEMA), Q.Contract(SCHEMA))
    assert Q.accepted(plain, CONTRACT).count() == 1


def test_another_header_stops_the_run(spark, tmp_path):
    with pytest.raises(Exception, match="header"):
        Q.read_csv(spark, _file(tmp_path, "id,other,s\n1,2,x\n"), SCHEMA).collect()


def test_schema_violations(spark):
    t = spark.createDataFrame([("1", 2.0, 3)], "id string, `a.b` double, more int")
    got = sorted(tuple(r) for r in Q.schema_violations(t, SCHEMA).collect())
    assert [r[:2] for r in got] == [("id", "type"), ("more", "extra"), ("s", "missing")]
