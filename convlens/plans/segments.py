"""Segment analytics: the result sets of the conversion report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.functions.columns import flag, ordinal, round_half_up, tier
from convlens.operators import conversion as C
from convlens.operators.percentiles import approx_median
from convlens.operators.ranking import Standing
from convlens.sources.contacts import (
    CONTACTS_SQL,
    contacts,
    contacts_once,
    customers,
    outcomes,
    read,
)

# Labels and limits of the report.
TIERS = [(20, "HIGH"), (10, "AVERAGE")]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
AGE_EDGES = [17, 25, 35, 45, 55, 65, 100]
AGE_LABELS = ["18-25", "26-35", "36-45", "46-55", "56-65", "66+"]
MIN_SEGMENT = 30
TOP_SEGMENTS = 20
LARGE_ORDER = 300_000


def age_band():
    age = F.col("age")
    return tier(
        [
            (age.between(17, 25), "18-25"),
            (age.between(26, 35), "26-35"),
            (age.between(36, 45), "36-45"),
            (age.between(46, 55), "46-55"),
            (age.between(56, 65), "56-65"),
        ],
        "66+",
    )


def job_tier():
    segment = F.col("segment")
    return tier(
        [
            (segment.isin("BUILDING", "MACHINERY"), "HIGH_VALUE"),
            (segment.isin("HOUSEHOLD"), "MID_VALUE"),
        ],
        "LOWER_VALUE",
    )


def contact_zone(count="contact_count"):
    n = F.col(count)
    return tier(
        [
            (n == 1, "FIRST CONTACT"),
            (n.between(2, 3), "OPTIMAL ZONE"),
            (n.between(4, 6), "DIMINISHING RETURNS"),
        ],
        "OVER-CONTACTED",
    )


def duration_bucket():
    seconds = F.col("duration")
    return tier(
        [
            (seconds < 60, "< 1 min"),
            (seconds < 180, "1-3 min"),
            (seconds < 300, "3-5 min"),
            (seconds < 600, "5-10 min"),
        ],
        "> 10 min",
    )


# -- results of a contact table -------------------------------------------------


def segment_result(res: DataFrame) -> DataFrame:
    """Rank, share and tier of a conversion by segment."""
    rate = F.col("conv_rate_pct")
    label = tier([(rate >= limit, name) for limit, name in TIERS], "LOW")
    res = C.with_share(C.with_rank(res)).withColumn("conversion_tier", label)
    return res.orderBy("rank_by_conv", "segment")


def priority_result(t: DataFrame) -> DataFrame:
    res = C.conversion(t, ["priority"]).withColumn(
        "priority_order", ordinal("priority", PRIORITIES, default=9).cast("long")
    )
    return C.vs_mean(C.with_share(res), "diff").orderBy("priority_order")


def region_result(t: DataFrame) -> DataFrame:
    averages = {
        "avg_age": round_half_up(F.avg("age"), 1),
        "avg_contacts": round_half_up(F.avg("campaign"), 2),
    }
    res = C.with_share(C.conversion(t, ["region"], extras=averages))
    return res.orderBy(F.col("conv_rate_pct").desc(), "region")


def contact_result(t: DataFrame) -> DataFrame:
    averages = {
        "avg_call_duration_sec": round_half_up(F.avg("duration"), 0),
        "avg_contacts": round_half_up(F.avg("campaign"), 2),
    }
    res = C.with_share(C.conversion(t, ["contact"], extras=averages))
    return res.orderBy(F.col("conv_rate_pct").desc(), "contact")


def contact_count_result(t: DataFrame) -> DataFrame:
    res = C.with_reach(C.conversion(t, {"contact_count": F.col("campaign")}), "contact_count")
    return res.withColumn("contact_zone", contact_zone()).orderBy("contact_count")


def prior_outcome_result(t: DataFrame) -> DataFrame:
    averages = {"avg_prior_contacts": round_half_up(F.avg("previous"), 2)}
    res = C.conversion(t, ["poutcome", "previously_contacted"], extras=averages)
    res = C.vs_mean(C.with_share(res), "index")
    return res.orderBy(F.col("conv_rate_pct").desc(), "poutcome")


def duration_outcome_result(t: DataFrame) -> DataFrame:
    averages = {"avg_contacts_this_campaign": "campaign", "avg_prior_contacts": "previous"}
    stats = C.profile_by_outcome(t, "y", "duration", averages)
    middle = approx_median(t, ["y"], "duration").select(
        F.col("y").alias("outcome"), F.col("approx_median").alias("approx_median_sec")
    )
    return stats.join(middle, "outcome", "left")


def duration_bucket_result(t: DataFrame) -> DataFrame:
    extras = {"_from": F.min("duration")}
    res = C.conversion(t, {"duration_bucket": duration_bucket()}, extras=extras)
    return C.with_share(res, name="pct_of_calls").orderBy("_from").drop("_from")


def top_segment_result(t: DataFrame) -> DataFrame:
    dims = {
        "age_band": age_band(),
        "job_tier": job_tier(),
        "previously_contacted": F.col("previously_contacted"),
    }
    averages = {
        "avg_age": round_half_up(F.avg("age"), 1),
        "avg_contacts": round_half_up(F.avg("campaign"), 2),
    }
    res = C.conversion(t, dims, extras=averages, min_n=MIN_SEGMENT)
    res = Standing(res).rank(name="segment_rank").share().table
    return (
        res.withColumnRenamed("total_clients", "clients")
        .orderBy("segment_rank", *dims)
        .limit(TOP_SEGMENTS)
    )


def temporal_result(t: DataFrame) -> DataFrame:
    res = C.multi_conversion(t, ["month", "day_of_week"])
    res = Standing(res, ["dimension"]).share(name="pct_of_calls").percent_rank().table
    return res.withColumnsRenamed(
        {"dimension": "time_dimension", "category": "period", "total_clients": "total_calls"}
    ).orderBy("time_dimension", F.col("conv_rate_pct").desc(), "period")


def kpi_result(t: DataFrame) -> DataFrame:
    return C.rollup_kpis(
        t, {"avg_call_duration_sec": ("duration", 1), "avg_campaign_contacts": ("campaign", 2)}
    )


# -- queries ----------------------------------------------------------------------


def overview(spark: SparkSession, folder: str) -> DataFrame:
    return C.overview(contacts(spark, folder, history=False))


def conv_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    return segment_result(
        C.conversion_by_lookup(
            outcomes(spark, folder),
            customers(spark, folder),
            "c_custkey",
            {"segment": F.col("c_mktsegment")},
        )
    )


def conv_by_priority_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    return priority_result(contacts(spark, folder, history=False))


def conv_by_region_avgs(spark: SparkSession, folder: str) -> DataFrame:
    return region_result(contacts(spark, folder))


def conv_multi_dimension(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "lineitem").withColumn("y_encoded", flag(F.col("l_quantity") >= 40))
    dims = {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")}
    return C.multi_conversion(t, dims).orderBy("dimension", F.col("conv_rate_pct").desc())


def conv_by_contact(spark: SparkSession, folder: str) -> DataFrame:
    return contact_result(contacts(spark, folder))


def conv_by_channel(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "events").withColumn("y_encoded", flag(F.col("value") >= 20))
    res = C.conversion(
        t,
        ["event_type"],
        extras={
            "avg_call_duration_sec": round_half_up(F.avg(F.floor("value")), 0),
            "avg_contacts": round_half_up(F.avg(F.col("user_id")), 2),
        },
    )
    return C.with_share(res).orderBy(F.col("conv_rate_pct").desc(), "event_type")


def conv_by_contact_count(spark: SparkSession, folder: str) -> DataFrame:
    return contact_count_result(contacts_once(spark, folder, ["campaign", "y_encoded"]))


def conv_by_prior_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return prior_outcome_result(contacts(spark, folder))


def value_by_outcome(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["y", "duration", "campaign", "previous"]
    return duration_outcome_result(contacts_once(spark, folder, columns))


def approx_median_query(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "lineitem")
    return approx_median(t, ["l_returnflag"], "l_quantity", digits=6).orderBy("l_returnflag")


def value_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return duration_bucket_result(contacts(spark, folder, history=False))


def top_segments(spark: SparkSession, folder: str) -> DataFrame:
    return top_segment_result(contacts(spark, folder))


def temporal(spark: SparkSession, folder: str) -> DataFrame:
    return temporal_result(contacts(spark, folder, history=False))


def temporal_events(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "events").withColumn("y_encoded", flag(F.col("event_type") == "purchase"))
    dims = {
        "weekday": F.lower(F.date_format("ts", "EEE")),
        "hour": F.lpad(F.hour("ts").cast("string"), 2, "0"),
    }
    res = C.with_share(C.multi_conversion(t, dims), name="pct_of_calls", by=["dimension"])
    return C.with_percent_rank(res, by=["dimension"]).orderBy("dimension", "category")


def _spending(spark: SparkSession, folder: str, dims: list[str]) -> DataFrame:
    t = read(spark, folder, "orders").withColumn("y_encoded", flag(F.col("o_totalprice") >= LARGE_ORDER))
    return C.conversion(t, dims, extras={"spend": round_half_up(F.sum("o_totalprice"), 2)})


def customer_standing(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's place among all; there is no bound on their number."""
    place = Standing(_spending(spark, folder, ["o_custkey"]))
    place.rank().rank("spend", "spend_rank").percent_rank("spend", "spend_percent_rank", 4)
    return place.share("spend", "pct_of_spend", 4).vs_mean("diff").vs_mean("index", digits=4).table


def customer_standing_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The same within each order priority."""
    place = Standing(_spending(spark, folder, ["o_orderpriority", "o_custkey"]), ["o_orderpriority"])
    place.rank().rank("spend", "spend_rank").percent_rank("spend", "spend_percent_rank", 4)
    return place.share("spend", "pct_of_spend", 4).vs_mean("diff").vs_mean("index", digits=4).table


def kpi_cube(spark: SparkSession, folder: str) -> DataFrame:
    return C.kpi_cube(contacts(spark, folder, history=False), ["segment", "priority", "region"])


def month_by_weekday(spark: SparkSession, folder: str) -> DataFrame:
    return C.cross_table(
        contacts(spark, folder, history=False), "month", "day_of_week", WEEKDAYS
    ).orderBy("month")


def best_worst(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts(spark, folder, history=False)
    dims = ["segment", "region", "nation", "priority", "contact"]
    return C.extremes(C.multi_conversion(t, dims), "category", by=["dimension"]).orderBy("dimension")


def top_bottom(spark: SparkSession, folder: str) -> DataFrame:
    res = C.conversion_by_lookup(
        outcomes(spark, folder),
        customers(spark, folder),
        "c_custkey",
        {"nation": F.col("n_name")},
    )
    return C.top_bottom(res, "nation")


def ordered_levels(spark: SparkSession, folder: str) -> DataFrame:
    t = read(spark, folder, "part").withColumn("y_encoded", flag(F.col("p_size") > 25))
    res = C.conversion(t, ["p_type"])
    return C.order_levels(res, "p_type", ["SMALL", "MEDIUM", "STANDARD", "LARGE", "JUMBO"])


def subset_rates(spark: SparkSession, folder: str) -> DataFrame:
    t = contacts(spark, folder)
    return C.subset_rates(
        t,
        {
            "first contact": F.col("campaign") == 1,
            "cellular": F.col("contact") == "cellular",
            "telephone": F.col("contact") == "telephone",
            "seen before": F.col("previously_contacted") == 1,
            "new": F.col("previously_contacted") == 0,
            "no such label": F.col("contact") == "fax",
        },
    )


def headline_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return kpi_result(contacts(spark, folder))


def label_rate_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "lang", "source")
    t = docs.join(read(spark, folder, "labels"), "doc_id")
    return C.conversion(t, ["lang", "source"], y="quality").orderBy("lang", "source")


QUERIES = {
    "overview": overview,
    "conv_by_segment": conv_by_segment,
    "conv_by_priority_ordinal": conv_by_priority_ordinal,
    "conv_by_region_avgs": conv_by_region_avgs,
    "conv_multi_dimension": conv_multi_dimension,
    "conv_by_contact": conv_by_contact,
    "conv_by_channel": conv_by_channel,
    "conv_by_contact_count": conv_by_contact_count,
    "conv_by_prior_outcome": conv_by_prior_outcome,
    "value_by_outcome": value_by_outcome,
    "approx_median": approx_median_query,
    "value_buckets": value_buckets,
    "top_segments": top_segments,
    "temporal": temporal,
    "temporal_events": temporal_events,
    "customer_standing": customer_standing,
    "customer_standing_by_priority": customer_standing_by_priority,
    "kpi_cube": kpi_cube,
    "month_by_weekday": month_by_weekday,
    "best_worst": best_worst,
    "top_bottom": top_bottom,
    "ordered_levels": ordered_levels,
    "subset_rates": subset_rates,
    "headline_kpis": headline_kpis,
    "label_rate_by_lang": label_rate_by_lang,
}

# -- the same results in SQL --------------------------------------------------


def rnd(x: str, digits: int = 2) -> str:
    """Round half away from zero, as in ``round_half_up``."""
    scale = f"1e{digits}"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale})"


def pct(num: str, den: str, digits: int = 2) -> str:
    return rnd(f"(100.0 * ({num}) / nullif({den}, 0))", digits)


N = "CAST(count(*) AS BIGINT)"
HITS = "CAST(coalesce(sum(y_encoded), 0) AS BIGINT)"
MEASURES = f"{N} AS total_clients, {HITS} AS subscribed, {pct(HITS, N)} AS conv_rate_pct"
SHARE = pct("total_clients", "sum(total_clients) OVER ()")


def _standing_sql(dims: list[str], by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = ", ".join(dims)
    return f"""WITH t AS (
        SELECT *, CASE WHEN o_totalprice >= {LARGE_ORDER} THEN 1 ELSE 0 END AS y_encoded FROM orders),
      g AS (SELECT {keys}, {MEASURES}, {rnd("sum(o_totalprice)")} AS spend FROM t GROUP BY {keys})
      SELECT *, rank() OVER ({part} ORDER BY conv_rate_pct DESC) AS rank_by_conv,
             rank() OVER ({part} ORDER BY spend DESC) AS spend_rank,
             {rnd(f"(100.0 * percent_rank() OVER ({part} ORDER BY spend))", 4)} AS spend_percent_rank,
             {pct("spend", f"sum(spend) OVER ({part})", 4)} AS pct_of_spend,
             {rnd(f"(conv_rate_pct - avg(conv_rate_pct) OVER ({part}))")} AS diff_from_mean_pp,
             {rnd(f"(conv_rate_pct / nullif(avg(conv_rate_pct) OVER ({part}), 0))", 4)} AS conv_index
      FROM g"""



def _multi(source: str, dims: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS dimension, CAST({c} AS VARCHAR) AS category, {MEASURES} "
        f"FROM {source} GROUP BY {c}"
        for name, c in dims.items()
    )


AGE_BAND_SQL = """CASE WHEN age BETWEEN 17 AND 25 THEN '18-25' WHEN age BETWEEN 26 AND 35 THEN '26-35'
 WHEN age BETWEEN 36 AND 45 THEN '36-45' WHEN age BETWEEN 46 AND 55 THEN '46-55'
 WHEN age BETWEEN 56 AND 65 THEN '56-65' ELSE '66+' END"""
JOB_TIER_SQL = """CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 'HIGH_VALUE'
 WHEN segment = 'HOUSEHOLD' THEN 'MID_VALUE' ELSE 'LOWER_VALUE' END"""
ZONE_SQL = """CASE WHEN contact_count = 1 THEN 'FIRST CONTACT'
 WHEN contact_count BETWEEN 2 AND 3 THEN 'OPTIMAL ZONE'
 WHEN contact_count BETWEEN 4 AND 6 THEN 'DIMINISHING RETURNS' ELSE 'OVER-CONTACTED' END"""
BUCKET_SQL = """CASE WHEN duration < 60 THEN '< 1 min' WHEN duration < 180 THEN '1-3 min'
 WHEN duration < 300 THEN '3-5 min' WHEN duration < 600 THEN '5-10 min' ELSE '> 10 min' END"""
PERCENT_RANK_SQL = rnd(
    "(100.0 * percent_rank() OVER (PARTITION BY dimension ORDER BY conv_rate_pct))", 1
)
DIMENSION_SHARE = pct("total_clients", "sum(total_clients) OVER (PARTITION BY dimension)")


def _subset(name: str, predicate: str) -> str:
    n = f"count(*) FILTER (WHERE {predicate})"
    h = f"count(*) FILTER (WHERE {predicate} AND y_encoded = 1)"
    return (
        f"SELECT '{name}' AS subset, {n} AS total_clients, {h} AS subscribed, "
        f"{pct(h, n)} AS conv_rate_pct FROM contacts"
    )


def _ranked_middle(source: str, by: str, col: str) -> str:
    return f"""SELECT {by}, {col}, 1.0 * row_number() OVER (PARTITION BY {by} ORDER BY {col})
      / count(*) OVER (PARTITION BY {by}) AS r FROM {source}"""


WITH = f"WITH {CONTACTS_SQL}"

ORACLE = {
    "overview": f"""{WITH}
      SELECT {N} AS total_clients, {HITS} AS total_subscribed,
             CAST(count(*) - sum(y_encoded) AS BIGINT) AS total_not_subscribed,
             {pct("sum(y_encoded)", "count(*)")} AS subscription_rate_pct,
             {pct("count(*) - sum(y_encoded)", "count(*)")} AS non_subscription_rate_pct,
             {rnd("(1.0 * (count(*) - sum(y_encoded)) / nullif(sum(y_encoded), 0))", 1)}
               AS imbalance_ratio_no_per_yes
      FROM contacts""",
    "conv_by_segment": f"""{WITH}, g AS (SELECT segment, {MEASURES} FROM contacts GROUP BY segment)
      SELECT *, rank() OVER (ORDER BY conv_rate_pct DESC) AS rank_by_conv,
             {SHARE} AS pct_of_dataset,
             CASE WHEN conv_rate_pct >= 20 THEN 'HIGH' WHEN conv_rate_pct >= 10 THEN 'AVERAGE'
                  ELSE 'LOW' END AS conversion_tier
      FROM g""",
    "conv_by_priority_ordinal": f"""{WITH},
      g AS (SELECT priority, {MEASURES} FROM contacts GROUP BY priority)
      SELECT *, CAST(CASE WHEN priority BETWEEN '1' AND '6' THEN CAST(priority[1] AS INTEGER)
                          ELSE 9 END AS BIGINT) AS priority_order,
             {SHARE} AS pct_of_dataset,
             {rnd("(conv_rate_pct - avg(conv_rate_pct) OVER ())")} AS diff_from_mean_pp
      FROM g""",
    "conv_by_region_avgs": f"""{WITH}, g AS (
        SELECT region, {MEASURES}, {rnd("avg(age)", 1)} AS avg_age,
               {rnd("avg(campaign)")} AS avg_contacts
        FROM contacts GROUP BY region)
      SELECT *, {SHARE} AS pct_of_dataset FROM g""",
    "conv_multi_dimension": f"""WITH t AS (
        SELECT *, CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END AS y_encoded FROM lineitem)
      {_multi("t", {"returnflag": "l_returnflag", "linestatus": "l_linestatus"})}""",
    "conv_by_contact": f"""{WITH}, g AS (
        SELECT contact, {MEASURES}, {rnd("avg(duration)", 0)} AS avg_call_duration_sec,
               {rnd("avg(campaign)")} AS avg_contacts
        FROM contacts GROUP BY contact)
      SELECT *, {SHARE} AS pct_of_dataset FROM g""",
    "conv_by_channel": f"""WITH t AS (
        SELECT *, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS y_encoded FROM events),
      g AS (SELECT event_type, {MEASURES},
                   {rnd("avg(CAST(floor(value) AS BIGINT))", 0)} AS avg_call_duration_sec,
                   {rnd("avg(user_id)")} AS avg_contacts
            FROM t GROUP BY event_type)
      SELECT *, {SHARE} AS pct_of_dataset FROM g""",
    "conv_by_contact_count": f"""{WITH}, g AS (
        SELECT campaign AS contact_count, {MEASURES} FROM contacts GROUP BY campaign)
      SELECT *, {pct("sum(total_clients) OVER (ORDER BY contact_count ROWS UNBOUNDED PRECEDING)",
                     "sum(total_clients) OVER ()", 1)} AS pct_clients_reached_by_this_count,
             {ZONE_SQL} AS contact_zone
      FROM g""",
    "conv_by_prior_outcome": f"""{WITH}, g AS (
        SELECT poutcome, previously_contacted, {MEASURES},
               {rnd("avg(previous)")} AS avg_prior_contacts
        FROM contacts GROUP BY poutcome, previously_contacted)
      SELECT *, {SHARE} AS pct_of_dataset,
             {rnd("(conv_rate_pct / nullif(avg(conv_rate_pct) OVER (), 0))")} AS conv_index
      FROM g""",
    "value_by_outcome": f"""{WITH}, r AS (
        SELECT *, 1.0 * row_number() OVER (PARTITION BY y ORDER BY duration)
                  / count(*) OVER (PARTITION BY y) AS duration_rank
        FROM contacts)
      SELECT y AS outcome, count(*) AS clients,
             {rnd("avg(duration)", 0)} AS avg_duration_sec,
             {rnd("(avg(duration) / 60.0)", 1)} AS avg_duration_min,
             min(duration) AS min_sec, max(duration) AS max_sec,
             {rnd("avg(campaign)")} AS avg_contacts_this_campaign,
             {rnd("avg(previous)")} AS avg_prior_contacts,
             {rnd("avg(CASE WHEN duration_rank BETWEEN 0.49 AND 0.51 THEN duration END)", 0)}
               AS approx_median_sec
      FROM r GROUP BY y""",
    "approx_median": f"""WITH r AS ({_ranked_middle("lineitem", "l_returnflag", "l_quantity")})
      SELECT l_returnflag, count(*) AS clients,
             {rnd("avg(CASE WHEN r BETWEEN 0.49 AND 0.51 THEN l_quantity END)", 6)}
               AS approx_median
      FROM r GROUP BY l_returnflag""",
    "value_buckets": f"""{WITH}, g AS (
        SELECT {BUCKET_SQL} AS duration_bucket, {MEASURES} FROM contacts GROUP BY 1)
      SELECT *, {SHARE} AS pct_of_calls FROM g""",
    "top_segments": f"""{WITH}, g AS (
        SELECT {AGE_BAND_SQL} AS age_band, {JOB_TIER_SQL} AS job_tier, previously_contacted,
               {MEASURES}, {rnd("avg(age)", 1)} AS avg_age, {rnd("avg(campaign)")} AS avg_contacts
        FROM contacts GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_SEGMENT})
      SELECT age_band, job_tier, previously_contacted, total_clients AS clients, subscribed,
             conv_rate_pct, avg_age, avg_contacts,
             rank() OVER (ORDER BY conv_rate_pct DESC) AS segment_rank, {SHARE} AS pct_of_dataset
      FROM g ORDER BY segment_rank, age_band, job_tier, previously_contacted
      LIMIT {TOP_SEGMENTS}""",
    "temporal": f"""{WITH}, g AS (
        {_multi("contacts", {"month": "month", "day_of_week": "day_of_week"})})
      SELECT dimension AS time_dimension, category AS period, total_clients AS total_calls,
             subscribed, conv_rate_pct, {DIMENSION_SHARE} AS pct_of_calls,
             {PERCENT_RANK_SQL} AS conv_percent_rank
      FROM g""",
    "temporal_events": f"""WITH t AS (
        SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y_encoded,
               lower(substr(dayname(ts), 1, 3)) AS weekday,
               lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS hour_of_day FROM events),
      g AS ({_multi("t", {"weekday": "weekday", "hour": "hour_of_day"})})
      SELECT *, {DIMENSION_SHARE} AS pct_of_calls, {PERCENT_RANK_SQL} AS conv_percent_rank
      FROM g""",
    "customer_standing": _standing_sql(["o_custkey"]),
    "customer_standing_by_priority": _standing_sql(["o_orderpriority", "o_custkey"], "o_orderpriority"),
    "kpi_cube": f"""{WITH}
      SELECT segment, priority, region,
             CAST(grouping(segment, priority, region) AS BIGINT) AS filter_id, {MEASURES}
      FROM contacts GROUP BY CUBE (segment, priority, region)""",
    "month_by_weekday": f"""{WITH}
      SELECT month, {", ".join(
          f"nullif(count(*) FILTER (WHERE day_of_week = '{d}'), 0) AS {d}_n, "
          + pct(f"sum(y_encoded) FILTER (WHERE day_of_week = '{d}')",
                f"count(*) FILTER (WHERE day_of_week = '{d}')") + f" AS {d}_rate"
          for d in WEEKDAYS)}
      FROM contacts GROUP BY month""",
    "best_worst": f"""{WITH}, g AS ({_multi("contacts", {
        d: d for d in ["segment", "region", "nation", "priority", "contact"]})})
      SELECT dimension,
             first(category ORDER BY conv_rate_pct DESC, category) AS best,
             max(conv_rate_pct) AS best_rate,
             first(category ORDER BY conv_rate_pct, category) AS worst,
             min(conv_rate_pct) AS worst_rate
      FROM g GROUP BY dimension""",
    "top_bottom": f"""{WITH}, g AS (SELECT nation, {MEASURES} FROM contacts GROUP BY nation)
      SELECT * FROM (SELECT *, 'top' AS "end" FROM g ORDER BY conv_rate_pct DESC, nation LIMIT 3)
      UNION ALL
      SELECT * FROM (SELECT *, 'bottom' AS "end" FROM g ORDER BY conv_rate_pct, nation LIMIT 3)""",
    "ordered_levels": f"""WITH t AS (
        SELECT *, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS y_encoded FROM part),
      l AS (SELECT * FROM (VALUES ('SMALL', 1), ('MEDIUM', 2), ('STANDARD', 3), ('LARGE', 4),
                                  ('JUMBO', 5)) v(p_type, position))
      SELECT p_type, {MEASURES}, any_value(position) AS position
      FROM t JOIN l USING (p_type) GROUP BY p_type""",
    "subset_rates": WITH + " UNION ALL ".join(
        _subset(name, predicate)
        for name, predicate in [
            ("first contact", "campaign = 1"),
            ("cellular", "contact = 'cellular'"),
            ("telephone", "contact = 'telephone'"),
            ("seen before", "previously_contacted = 1"),
            ("new", "previously_contacted = 0"),
            ("no such label", "contact = 'fax'"),
        ]
    ),
    "headline_kpis": f"""{WITH}
      SELECT {N} AS total_clients, {HITS} AS total_subscribed,
             CAST(count(*) - sum(y_encoded) AS BIGINT) AS total_not_subscribed,
             {pct("sum(y_encoded)", "count(*)")} AS subscription_rate,
             {rnd("(1.0 * (count(*) - sum(y_encoded)) / nullif(sum(y_encoded), 0))", 1)}
               AS imbalance_ratio,
             {rnd("avg(duration)", 1)} AS avg_call_duration_sec,
             {rnd("avg(campaign)")} AS avg_campaign_contacts
      FROM contacts""",
    "label_rate_by_lang": f"""SELECT lang, source, {MEASURES.replace("y_encoded", "quality")}
      FROM documents JOIN labels USING (doc_id) GROUP BY lang, source""",
}
