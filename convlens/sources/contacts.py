"""A table of sales contacts over the star schema: one row per order.

It stands in for a telemarketing fact table: who was contacted, when, for how long, what
happened before, and whether it ended in a sale (``y_encoded``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.functions.columns import flag
from convlens.operators.slicing import (
    HEAVY_ROWS,
    HEAVY_SHARE,
    MAX_SLICES,
    VALUES_PER_SLICE,
    heavy_values,
    sketched_quantiles,
    with_slice,
)
from convlens.sources.staging import stage
from convlens.sources.tables import read_table

NO_HISTORY = 999  # days since the previous contact, when there was none


# Declared, so that no job has to read file footers before a query starts.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", SCHEMAS[name])


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their nation and region; one row per customer key."""
    customer = read(spark, folder, "customer")
    nation = read(spark, folder, "nation")
    region = read(spark, folder, "region")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )


def with_dimensions(spark: SparkSession, folder: str, orders: DataFrame) -> DataFrame:
    """Attach customer, nation and region.

    No broadcast hints: Spark broadcasts a side whose size in bytes it knows to be small,
    and otherwise shuffles, where AQE splits the partitions of customers with very many
    orders.
    """
    return orders.join(customers(spark, folder), F.col("o_custkey") == F.col("c_custkey"))


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Customer key and label of every contact, for results that need nothing else of it."""
    return read(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), _label().alias("y_encoded")
    )


def _label():
    return flag(F.col("o_orderstatus") == "F")


def with_history(
    orders: DataFrame,
    share: float = HEAVY_SHARE,
    min_rows: int = HEAVY_ROWS,
    rows_per_slice: int = VALUES_PER_SLICE,
) -> DataFrame:
    """Per customer, in order of date and order key: contacts before, the last date and status.

    A window by customer puts a customer into one task. That is right for nearly all of
    them; customers that hold more than ``share`` of the rows (at most ``1 / share``) are
    cut into slices of time, and only one row per slice is carried over.
    """
    heavy = [r["o_custkey"] for r in heavy_values(orders, ["o_custkey"], share, min_rows)]
    if not heavy:
        return _plain_history(orders)
    is_heavy = F.col("o_custkey").isin(heavy)
    light = _plain_history(orders.where(~is_heavy | F.col("o_custkey").isNull()))
    return light.unionByName(
        _sliced_history(orders.where(is_heavy), share, min_rows, rows_per_slice)
    )


def _plain_history(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.withColumns(
        {
            "previous": F.row_number().over(w) - 1,
            "last_date": F.lag("o_orderdate").over(w),
            "last_status": F.lag("o_orderstatus").over(w),
        }
    )


def _moment(t: DataFrame, col: str):
    """A number that grows with a date or time; local times are not shifted by a time zone."""
    if isinstance(t.schema[col].dataType, T.TimestampNTZType):
        return (
            F.unix_date(F.to_date(col)).cast("double") * 86400.0
            + F.hour(col) * 3600.0
            + F.minute(col) * 60.0
            + F.date_part(F.lit("SECOND"), F.col(col)).cast("double")
        )
    return F.unix_micros(F.col(col).cast("timestamp")).cast("double")


def _sliced_history(
    orders: DataFrame, share: float, min_rows: int, rows_per_slice: int
) -> DataFrame:
    """The same columns, with the window cut by date, and by key where one date is hot."""
    slices = min(MAX_SLICES, max(2, math.ceil(orders.count() / rows_per_slice)))
    orders = orders.withColumns(
        {
            "_date": _moment(orders, "o_orderdate"),
            "_key": F.col("o_orderkey").cast("double"),
        }
    )
    probs = [i / slices for i in range(1, slices)]
    cuts = sketched_quantiles(orders, {"dates": F.col("_date"), "keys": F.col("_key")}, probs)
    hot_dates = [r["_date"] for r in heavy_values(orders, ["_date"], share, min_rows)]

    # (_slice, _late, _part) grows with (date, key): a hot date starts a slice of its own
    # and is cut again by key, the later dates of that slice come after it
    t = with_slice(orders, "_date", sorted({*cuts["dates"], *hot_dates}))
    t = with_slice(t, "_key", cuts["keys"], "_part")
    on_hot = F.col("_date").isin(hot_dates) if hot_dates else F.lit(False)
    t = t.withColumns(
        {
            "_late": F.when(on_hot, 0).otherwise(1),
            "_part": F.when(on_hot, F.col("_part")).otherwise(0.0),
        }
    )
    cell = ["o_custkey", "_slice", "_late", "_part"]
    inner = Window.partitionBy(*cell).orderBy("o_orderdate", "o_orderkey")
    t = t.withColumns(
        {
            "previous": F.row_number().over(inner) - 1,
            "last_date": F.lag("o_orderdate").over(inner),
            "last_status": F.lag("o_orderstatus").over(inner),
        }
    )
    newest = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))
    across = Window.partitionBy("o_custkey").orderBy("_slice", "_late", "_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        t.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_rows"), newest.alias("_newest"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
                "_carry": F.lag("_newest").over(across),
            }
        )
        .drop("_rows", "_newest")
    )
    first = F.col("previous") == 0
    return (
        t.join(carried, cell)
        .withColumns(
            {
                "last_date": F.when(first, F.col("_carry.o_orderdate")).otherwise(
                    F.col("last_date")
                ),
                "last_status": F.when(first, F.col("_carry.o_orderstatus")).otherwise(
                    F.col("last_status")
                ),
                "previous": (F.col("previous") + F.col("_before")).cast("int"),
            }
        )
        .drop("_date", "_key", "_slice", "_late", "_part", "_before", "_carry")
    )


def contacts(
    spark: SparkSession,
    folder: str,
    history: bool = True,
    share: float = HEAVY_SHARE,
    min_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """The contact table. Leave ``history`` out where no column of it is needed."""
    orders = read(spark, folder, "orders")
    if history:
        orders = with_history(orders, share, min_rows)
    t = with_dimensions(spark, folder, orders)
    columns = {
        "id": F.col("o_orderkey"),
        "y": F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no"),
        "y_encoded": _label(),
        "segment": F.col("c_mktsegment"),
        "priority": F.col("o_orderpriority"),
        "region": F.col("r_name"),
        "nation": F.col("n_name"),
        "contact": F.when(F.col("o_orderpriority") < "4", "cellular").otherwise("telephone"),
        "price": F.col("o_totalprice"),
        "balance": F.col("c_acctbal"),
        # whole numbers in the ranges of an age and of a call in seconds
        "age": (F.floor((F.col("c_acctbal") + 1000.0) / 135.0) + 17).cast("int"),
        "duration": F.floor(F.col("o_totalprice") / 100.0).cast("int"),
        "month": F.lower(F.date_format("o_orderdate", "MMM")),
        "day_of_week": F.lower(F.date_format("o_orderdate", "EEE")),
        "contact_date": F.col("o_orderdate"),
    }
    if history:
        columns |= {
            "campaign": F.col("previous") + 1,
            "previous": F.col("previous"),
            "pdays": F.when(F.col("last_date").isNull(), NO_HISTORY).otherwise(
                F.datediff("o_orderdate", "last_date")
            ),
            "poutcome": F.when(F.col("last_date").isNull(), "nonexistent")
            .when(F.col("last_status") == "F", "success")
            .otherwise("failure"),
            "previously_contacted": flag(F.col("last_date").isNotNull()),
        }
    return t.select(*[c.alias(name) for name, c in columns.items()])


def contacts_once(
    spark: SparkSession, folder: str, columns: Sequence[str] | None = None, history: bool = True
) -> DataFrame:
    """The contact table, or some columns of it, written once for work that reads it often."""
    t = contacts(spark, folder, history)
    return stage(t.select(*columns) if columns else t, "contacts")


CONTACTS_SQL = """
contacts AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS y,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_encoded,
         c_mktsegment AS segment, o_orderpriority AS priority,
         r_name AS region, n_name AS nation,
         CASE WHEN o_orderpriority < '4' THEN 'cellular' ELSE 'telephone' END AS contact,
         o_totalprice AS price, c_acctbal AS balance,
         CAST(floor((c_acctbal + 1000.0) / 135.0) + 17 AS INTEGER) AS age,
         CAST(floor(o_totalprice / 100.0) AS INTEGER) AS duration,
         lower(substr(monthname(o_orderdate), 1, 3)) AS month,
         lower(substr(dayname(o_orderdate), 1, 3)) AS day_of_week,
         o_orderdate AS contact_date,
         CAST(row_number() OVER w AS INTEGER) AS campaign,
         CAST(row_number() OVER w - 1 AS INTEGER) AS previous,
         CAST(coalesce(date_diff('day', lag(o_orderdate) OVER w, o_orderdate), 999) AS INTEGER)
           AS pdays,
         CASE WHEN lag(o_orderdate) OVER w IS NULL THEN 'nonexistent'
              WHEN lag(o_orderstatus) OVER w = 'F' THEN 'success'
              ELSE 'failure' END AS poutcome,
         CASE WHEN lag(o_orderdate) OVER w IS NULL THEN 0 ELSE 1 END AS previously_contacted
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
)"""
