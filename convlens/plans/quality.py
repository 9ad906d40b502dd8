"""Profiling, data quality and cleaning queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.columns import band, text_key
from convlens.operators import cleaning as K
from convlens.operators import profiling as P
from convlens.operators.conversion import conversion
from convlens.plans.segments import AGE_EDGES, AGE_LABELS, WITH, pct, rnd
from convlens.sources import quarantine as Q
from convlens.sources.contacts import contacts, contacts_once, read
from convlens.sources.staging import shared_folder
from convlens.sources.tables import load_result, write_table

CUSTOMER_META = {
    "c_custkey": ("Numerical", "Customer key"),
    "c_name": ("Categorical", "Customer name"),
    "c_nationkey": ("Numerical", "Nation of the customer"),
    "c_acctbal": ("Numerical", "Account balance"),
    "c_mktsegment": ("Categorical", "Market segment"),
}
LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def data_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "customer")
    return P.data_dictionary(t, CUSTOMER_META, unknown_in=["c_mktsegment"], unknown="BUILDING")


def describe(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "lineitem")
    return P.describe(t)


def moments(spark: SparkSession, folder: str) -> DataFrame:
    t = P.moments(contacts(spark, folder), ["age", "duration", "campaign", "pdays", "previous"])
    return t.select("column", "count", "mean", "std", "min", "max", "skewness", "kurtosis")


def distribution(spark: SparkSession, folder: str) -> DataFrame:
    return P.distribution(read(spark, folder, "events"), "event_type")


def target_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return P.distribution(contacts(spark, folder, history=False), "y")


def levels(spark: SparkSession, folder: str) -> DataFrame:
    return P.levels(read(spark, folder, "part"), ["p_brand", "p_type"])


def sentinel_counts(spark: SparkSession, folder: str) -> DataFrame:
    return P.sentinel_counts(
        contacts(spark, folder),
        {
            "pdays == 999": F.col("pdays") == 999,
            "age > 80": F.col("age") > 80,
            "duration == 0": F.col("duration") == 0,
            "poutcome nonexistent": F.col("poutcome") == "nonexistent",
        },
    )


def outliers(spark: SparkSession, folder: str) -> DataFrame:
    return P.outliers(read(spark, folder, "events"), "value", 0.99)


def duplicate_count(spark: SparkSession, folder: str) -> DataFrame:
    return P.duplicate_count(read(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return P.duplicate_groups(
        read(spark, folder, "documents"), {"text_key": text_key("text"), "lang": F.col("lang")}
    )


def dedup(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    return _dated(K.dedup(t, ["l_orderkey", "l_linenumber"], order))


def dedup_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _dated(K.dedup(read(spark, folder, "lineitem")))


def _dated(lines: DataFrame) -> DataFrame:
    """Order lines with the ship date as text, which reads alike in every engine."""
    return lines.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


def _noisy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as raw input: padded upper-case text, numbers as text, a yes/no label."""
    t = read(spark, folder, "lineitem")
    return t.select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit(" \t"), "l_returnflag", F.lit("  ")).alias("return.flag"),
        F.col("l_linestatus").alias("line.status"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.floor(F.col("l_extendedprice") / 1000.0).cast("string").alias("price"),
        F.when(F.col("l_returnflag") == "R", " YES ").otherwise("No").alias("y"),
    )


def _rules() -> list[K.Rule]:
    return [
        K.drop_exact_duplicates(),
        K.keep_rows("Drop quantity <= 1", F.col("quantity") > 1, "quantity"),
        K.standardise("y", "yes", {"price": "int"}),
        K.keep_label(["return.flag"], "n"),
        K.add_sentinel_flag("return.flag", "n", "returned_or_accepted"),
        K.winsorise("price", 0.99),
        K.rename({"return.flag": "return_flag", "line.status": "line_status"}),
        K.keep_rows("Drop orders without a price", F.col("price") >= 2, "price"),
    ]


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return K.clean(_noisy_lines(spark, folder), _rules())[0]


def clean_audit(spark: SparkSession, folder: str) -> DataFrame:
    return K.clean(_noisy_lines(spark, folder), _rules())[1]


def clean_report(spark: SparkSession, folder: str) -> DataFrame:
    raw = _noisy_lines(spark, folder)
    cleaned, _ = K.clean(raw, _rules())
    before = raw.withColumnRenamed("return.flag", "return_flag")
    before = before.withColumn("y", F.lower(F.trim("y")))
    return K.clean_report(before, cleaned, "y", ["return_flag"], "n")


def winsorise(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts_once(spark, folder, ["id", "duration"], history=False)
    change, _ = K.winsorise("duration", 0.99).fit(t)
    return change(t)


def standardise(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "customer").select(
        "c_custkey",
        F.concat(F.lit("  "), F.upper("c_mktsegment"), F.lit(" \n")).alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.when(F.col("c_acctbal") > 0, " Yes").otherwise("no ").alias("y"),
    )
    return K.standardise_columns(t, "y", "yes", {"nation": "int"})


def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts_once(spark, folder)
    checks = [
        P.Check("poutcome nonexistent", F.col("poutcome") == "nonexistent", "Keep as a category"),
        P.Check("unknown region", F.col("region") == "unknown", "Keep as a category"),
        P.Check("duration == 0", F.col("duration") == 0, "Drop the rows", "Low"),
        P.Check("pdays == 999", F.col("pdays") == 999, "Add a flag", "Medium"),
        P.Check("age > 80", F.col("age") > 80, "Keep"),
    ]
    return P.quality_summary(t, checks, "y_encoded")


def validate_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return K.validate_ranges(
        contacts(spark, folder),
        {
            "age in [20, 90]": ("age", 20, 90),
            "campaign >= 1": ("campaign", 1, None),
            "previous >= 0": ("previous", 0, None),
        },
    )


def missing_values(spark: SparkSession, folder: str) -> DataFrame:
    """Bands over a column with missing values: they form a group of their own."""
    t = contacts(spark, folder, history=False)
    age = F.when(F.col("priority") != "5-LOW", F.col("age"))
    return conversion(t, {"age_band": band(age, AGE_EDGES, AGE_LABELS)})


# What an export of orders has to hold.
ORDER_CONTRACT = Q.Contract(
    T.StructType(
        [
            T.StructField("o_orderkey", T.LongType(), False),
            T.StructField("o_custkey", T.LongType(), False),
            T.StructField("o_orderstatus", T.StringType(), True),
            T.StructField("o_totalprice", T.DoubleType(), True),
            T.StructField("o_orderpriority", T.StringType(), False),
        ]
    ),
    {
        "price below zero": "o_totalprice >= 0",
        "status unknown": "o_orderstatus IN ('O', 'F', 'P')",
    },
    key=["o_orderkey"],
)


def _order_export(spark: SparkSession, folder: str) -> str:
    """Orders as a CSV folder with damage in it: unreadable and negative prices, customers left out,
    unknown states, repeated orders, and quotes and commas that are no damage. All rows are in it."""
    t = read(spark, folder, "orders").drop("o_orderdate")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    t = t.select(
        "o_orderkey",
        F.when(key % 89 != 5, F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 71 == 2, "?").when(key % 13 != 4, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 97 == 3, "n/a").otherwise(F.when(key % 83 == 7, -price).otherwise(price).cast("string")).alias("o_totalprice"),
        F.concat("o_orderpriority", F.when(key % 2 == 0, ', "x"').otherwise("")).alias("o_orderpriority"),
    )
    t = t.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(key % 101 == 9, 2).otherwise(1)))).drop("_copy")
    path = f"{shared_folder(spark).rstrip('/')}/orders-{uuid.uuid4().hex}"
    write_table(t, f"{path}/export.csv", "csv")
    return path


def csv_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a damaged export by reason, and what was written apart, read again."""
    path = _order_export(spark, folder)
    counts = Q.load(spark, f"{path}/export.csv", ORDER_CONTRACT, path)
    again = load_result(spark, path, "rejected").agg(F.count(F.lit(1)).alias("rows"))
    return counts.unionByName(again.select(F.lit("read again").alias("reason"), "rows"))


def csv_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the export that keep the contract, after writing and reading them again."""
    path = _order_export(spark, folder)
    Q.load(spark, f"{path}/export.csv", ORDER_CONTRACT, path)
    return load_result(spark, path, "accepted")


QUERIES = {
    f.__name__: f
    for f in [
        data_dictionary,
        describe,
        moments,
        distribution,
        target_distribution,
        levels,
        sentinel_counts,
        outliers,
        duplicate_count,
        duplicate_groups,
        dedup,
        dedup_exact,
        clean,
        clean_audit,
        clean_report,
        winsorise,
        standardise,
        quality_summary,
        validate_ranges,
        missing_values,
        csv_quarantine,
        csv_accepted,
    ]
}

# -- the same results in SQL --------------------------------------------------


def _dictionary_row(c: str, dtype: str, role: str, text: str, numeric: bool, flagged: bool) -> str:
    if numeric:
        stats = (
            f"{rnd(f'CAST(min({c}) AS DOUBLE)', 4)} AS min, {rnd(f'CAST(max({c}) AS DOUBLE)', 4)} AS max, "
            f"{rnd(f'avg({c})', 4)} AS mean, {rnd(f'stddev_samp({c})', 4)} AS std, "
            "'' AS sample_values"
        )
    else:
        stats = (
            "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, "
            "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
            f"array_to_string((list_sort(list(DISTINCT {c})))[1:8], ', ') AS sample_values"
        )
    label = f"CASE WHEN bool_or({c} = 'BUILDING') THEN 'YES' ELSE 'no' END" if flagged else "''"
    return (
        f"SELECT '{c}' AS \"column\", '{dtype}' AS dtype, '{role}' AS category, "
        f"'{text}' AS description, count(DISTINCT {c}) AS n_unique, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"{pct(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')} AS null_pct, "
        f"{label} AS has_unknown_label, {stats} FROM customer"
    )


def _describe_row(c: str, source: str) -> str:
    parts = {
        "mean": f"avg({c})",
        "std": f"stddev_samp({c})",
        "min": f"CAST(min({c}) AS DOUBLE)",
        "p25": f"quantile_cont({c}, 0.25)",
        "p50": f"quantile_cont({c}, 0.5)",
        "p75": f"quantile_cont({c}, 0.75)",
        "max": f"CAST(max({c}) AS DOUBLE)",
        "skewness": f"skewness({c})",
        "kurtosis": f"kurtosis({c})",
    }
    stats = ", ".join(f"{rnd(x, 4)} AS {name}" for name, x in parts.items())
    return f"SELECT '{c}' AS \"column\", count({c}) AS count, {stats} FROM {source}"


def _distribution(c: str, source: str) -> str:
    return (
        f"SELECT {c} AS value, count(*) AS count, "
        f"{pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM {source} GROUP BY {c}"
    )


def _rule(name: str, predicate: str) -> str:
    n = f"count(*) FILTER (WHERE {predicate})"
    return f"SELECT '{name}' AS \"check\", {n} AS rows, {pct(n, 'count(*)')} AS pct FROM contacts"


NOISY_SQL = """
noisy AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS return_flag, l_linestatus AS line_status,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(floor(l_extendedprice / 1000.0) AS INTEGER) AS price,
         CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS y
  FROM lineitem),
once AS (SELECT DISTINCT * FROM noisy),
valid AS (SELECT * FROM once WHERE quantity > 1),
capped AS (
  SELECT l_orderkey, l_linenumber, lower(return_flag) AS return_flag,
         lower(line_status) AS line_status, quantity,
         CAST(least(price, (SELECT floor(quantile_cont(price, 0.99)) FROM valid)) AS INTEGER)
           AS price,
         y, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS y_encoded,
         CASE WHEN lower(return_flag) <> 'n' THEN 1 ELSE 0 END AS returned_or_accepted
  FROM valid),
cleaned AS (SELECT * FROM capped WHERE price >= 2),
n AS (SELECT (SELECT count(*) FROM noisy) AS raw, (SELECT count(*) FROM once) AS once,
             (SELECT count(*) FROM valid) AS valid, (SELECT count(*) FROM cleaned) AS cleaned,
             (SELECT CAST(floor(quantile_cont(price, 0.99)) AS INTEGER) FROM valid) AS cap)"""


def _step(i: int, rule: str, decision: str, before: str, after: str, cols: str, notes: str) -> str:
    return (
        f"SELECT {i} AS step, {rule} AS rule, '{decision}' AS decision, {before} AS rows_before, "
        f"{after} AS rows_after, {before} - {after} AS rows_removed, "
        f"'{cols}' AS cols_affected, {notes} AS notes FROM n"
    )


AUDIT_SQL = " UNION ALL ".join(
    [
        _step(2, "'Remove exact duplicates'", "Keep one copy of each row", "raw", "once", "all", "''"),
        _step(3, "'Drop quantity <= 1'", "Remove the other rows", "once", "valid", "quantity", "''"),
        _step(
            4,
            "'Standardise types and text'",
            "Strip and lower-case text; cast numbers; encode the label",
            "valid",
            "valid",
            "text columns, price, y_encoded",
            "''",
        ),
        _step(
            5,
            "'Retain ''n'' in return.flag'",
            "Keep as a category",
            "valid",
            "valid",
            "return.flag",
            "'No imputation'",
        ),
        _step(
            6,
            "'Flag returned_or_accepted'",
            "1 where return.flag != n",
            "valid",
            "valid",
            "return.flag (new: returned_or_accepted)",
            "''",
        ),
        _step(
            7,
            "'Cap price at percentile 0.99'",
            "Winsorise",
            "valid",
            "valid",
            "price",
            "printf('cap %d: %d values capped', cap, "
            "(SELECT count(*) FROM valid, n WHERE valid.price > n.cap))",
        ),
        _step(
            8,
            "'Rename columns'",
            "return.flag->return_flag, line.status->line_status",
            "valid",
            "valid",
            "return.flag, line.status",
            "'Names only'",
        ),
        _step(
            9,
            "'Drop orders without a price'",
            "Remove the other rows",
            "valid",
            "cleaned",
            "price",
            "''",
        ),
    ]
)

_CLEAN_COLUMNS = (
    "l_orderkey, l_linenumber, return_flag, line_status, quantity, price, y, y_encoded, "
    "returned_or_accepted"
)


def _side(expr: str, measure: str) -> str:
    return (
        f"SELECT '{measure}' AS measure, (SELECT {expr} FROM noisy) AS before, "
        f"(SELECT {expr} FROM cleaned) AS after"
    )


REPORT_SQL = " UNION ALL ".join(
    [
        _side("count(*)", "rows"),
        "SELECT 'columns', 7, 9",
        "SELECT 'null cells', 0, 0",
        _side("count(*) FILTER (WHERE y = 'yes')", "label yes"),
        _side("count(*) FILTER (WHERE y = 'no')", "label no"),
        # the raw flag is padded and upper case, so no raw label equals 'n'
        "SELECT 'unknown in return_flag', 0, "
        "(SELECT count(*) FROM cleaned WHERE return_flag = 'n')",
        f"SELECT 'exact duplicates', (SELECT count(*) - (SELECT count(*) FROM once) FROM noisy), "
        f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_CLEAN_COLUMNS} FROM cleaned)) "
        "FROM cleaned)",
    ]
)


def _graded(name: str, predicate: str, severity: str | None, advice: str) -> str:
    n = f"count(*) FILTER (WHERE {predicate})"
    share = f"100.0 * {n} / count(*)"
    grade = (
        f"'{severity}'"
        if severity
        else f"CASE WHEN {rnd(f'({share})')} > 10 THEN 'High' WHEN {rnd(f'({share})')} > 1 "
        "THEN 'Medium' ELSE 'Low' END"
    )
    return (
        f"SELECT '{name}' AS \"check\", {n} AS rows, "
        f"printf('%d rows (%.2f%%)', {n}, {rnd(f'({share})')}) AS finding, "
        f"{grade} AS severity, '{advice}' AS recommendation FROM contacts"
    )


QUALITY_SQL = " UNION ALL ".join(
    [
        "SELECT 'Structural nulls' AS \"check\", 0 AS rows, '0 null cells' AS finding, "
        "'None' AS severity, 'Fill or drop missing cells' AS recommendation",
        "SELECT 'Exact duplicate rows', d, printf('%d duplicates', d), "
        "CASE WHEN d > 0 THEN 'Medium' ELSE 'None' END, 'Inspect and remove true duplicates' "
        "FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM contacts)) AS d "
        "FROM contacts)",
        _graded("poutcome nonexistent", "poutcome = 'nonexistent'", None, "Keep as a category"),
        _graded("unknown region", "region = 'unknown'", None, "Keep as a category"),
        _graded("duration == 0", "duration = 0", "Low", "Drop the rows"),
        _graded("pdays == 999", "pdays = 999", "Medium", "Add a flag"),
        _graded("age > 80", "age > 80", None, "Keep"),
        "SELECT 'Class imbalance', CAST(sum(y_encoded) AS BIGINT), printf('no=%d yes=%d ratio=%.1f:1', "
        "count(*) - sum(y_encoded), sum(y_encoded), "
        f"{rnd('(1.0 * (count(*) - sum(y_encoded)) / sum(y_encoded))', 1)}), 'High', "
        "'Use stratified splits and class weights' FROM contacts",
    ]
)


def _range_row(name: str, predicate: str) -> str:
    n = f"count(*) FILTER (WHERE {predicate})"
    return f"SELECT '{name}' AS \"check\", {n} AS rows_outside, {n} = 0 AS valid FROM contacts"


BAND_SQL = """CASE WHEN a IS NULL OR a < 17 THEN NULL WHEN a <= 25 THEN '18-25' WHEN a <= 35 THEN '26-35'
 WHEN a <= 45 THEN '36-45' WHEN a <= 55 THEN '46-55' WHEN a <= 65 THEN '56-65'
 WHEN a <= 100 THEN '66+' END"""

EXPORT_SQL = """WITH e AS (
    SELECT o_orderkey, CASE WHEN o_orderkey % 89 <> 5 THEN o_custkey END AS o_custkey,
           CASE WHEN o_orderkey % 71 = 2 THEN '?' WHEN o_orderkey % 13 <> 4 THEN o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 83 = 7 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
           o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ', "x"' ELSE '' END AS o_orderpriority,
           o_orderkey % 97 = 3 AS malformed, unnest(range(CASE WHEN o_orderkey % 101 = 9 THEN 2 ELSE 1 END)) AS copy
    FROM orders),
  r AS (
    SELECT *, CASE WHEN malformed THEN ['malformed'] ELSE [x FOR x IN [
             CASE WHEN o_custkey IS NULL THEN 'missing o_custkey' END,
             CASE WHEN o_totalprice < 0 THEN 'price below zero' END,
             CASE WHEN o_orderstatus = '?' THEN 'status unknown' END,
             CASE WHEN o_orderkey % 101 = 9 THEN 'repeated key' END] IF x IS NOT NULL] END AS reasons
    FROM e)"""

ORACLE = {
    "csv_quarantine": f"""{EXPORT_SQL}
      SELECT reason, count(*) AS rows FROM (
        SELECT CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'rejected' END AS reason FROM r
        UNION ALL SELECT unnest(reasons) FROM r
        UNION ALL SELECT 'read again' FROM r WHERE len(reasons) > 0) GROUP BY reason""",
    "csv_accepted": f"""{EXPORT_SQL}
      SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
      FROM r WHERE len(reasons) = 0""",
    "data_dictionary": " UNION ALL ".join(
        _dictionary_row(c, dtype, *CUSTOMER_META[c], numeric, c == "c_mktsegment")
        for c, dtype, numeric in [
            ("c_custkey", "bigint", True),
            ("c_name", "string", False),
            ("c_nationkey", "int", True),
            ("c_acctbal", "double", True),
            ("c_mktsegment", "string", False),
        ]
    ),
    "describe": " UNION ALL ".join(
        _describe_row(c, "lineitem")
        for c in LINE_NUMBERS
    ),
    "moments": f"{WITH}, d AS ("
    + " UNION ALL ".join(
        _describe_row(c, "contacts") for c in ["age", "duration", "campaign", "pdays", "previous"]
    )
    + ') SELECT "column", count, mean, std, min, max, skewness, kurtosis FROM d',
    "distribution": _distribution("event_type", "events"),
    "target_distribution": f"{WITH} {_distribution('y', 'contacts')}",
    "levels": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS level, count(*) AS rows FROM part GROUP BY {c}"
        for c in ["p_brand", "p_type"]
    ),
    "sentinel_counts": WITH
    + " UNION ALL ".join(
        _rule(name, predicate)
        for name, predicate in [
            ("pdays == 999", "pdays = 999"),
            ("age > 80", "age > 80"),
            ("duration == 0", "duration = 0"),
            ("poutcome nonexistent", "poutcome = 'nonexistent'"),
        ]
    ),
    "outliers": """WITH q AS (SELECT quantile_cont(value, 0.99) AS threshold FROM events)
      SELECT 'value' AS "column", any_value(threshold) AS threshold, count(*) AS total_rows,
             count(*) FILTER (WHERE value > threshold) AS rows_above
      FROM events, q""",
    "duplicate_count": """SELECT count(*) AS repeated_groups,
             CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS extra_copies
      FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber
            HAVING count(*) > 1)""",
    "duplicate_groups": """SELECT sha256(text) AS text_key, lang, count(*) AS copies
      FROM documents GROUP BY text, lang HAVING count(*) > 1""",
    "dedup": """SELECT * EXCLUDE (nr) REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS nr FROM lineitem)
      WHERE nr = 1""",
    "dedup_exact": """SELECT DISTINCT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate)
      FROM lineitem""",
    "clean": f"WITH {NOISY_SQL} SELECT {_CLEAN_COLUMNS} FROM cleaned",
    "clean_audit": f"WITH {NOISY_SQL} {AUDIT_SQL}",
    "clean_report": f"WITH {NOISY_SQL} {REPORT_SQL}",
    "winsorise": f"""{WITH}, q AS (SELECT floor(quantile_cont(duration, 0.99)) AS cap FROM contacts)
      SELECT id, CAST(least(duration, cap) AS INTEGER) AS duration FROM contacts, q""",
    "standardise": """SELECT c_custkey, lower(c_mktsegment) AS segment, c_nationkey AS nation,
             CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS y,
             CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS y_encoded
      FROM customer""",
    "quality_summary": f"{WITH} {QUALITY_SQL}",
    "validate_ranges": WITH
    + " UNION ALL ".join(
        _range_row(name, predicate)
        for name, predicate in [
            ("age in [20, 90]", "age < 20 OR age > 90"),
            ("campaign >= 1", "campaign < 1"),
            ("previous >= 0", "previous < 0"),
        ]
    ),
    "missing_values": f"""{WITH}, a AS (
        SELECT y_encoded, CASE WHEN priority <> '5-LOW' THEN age END AS a FROM contacts),
      b AS (SELECT y_encoded, {BAND_SQL} AS age_band FROM a)
      SELECT age_band, count(*) AS total_clients, CAST(sum(y_encoded) AS BIGINT) AS subscribed,
             {pct("sum(y_encoded)", "count(*)")} AS conv_rate_pct
      FROM b GROUP BY age_band""",
}
