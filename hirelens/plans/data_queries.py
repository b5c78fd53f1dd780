"""Registered dedup and profiling queries over the raw driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import dedup, profile
from ..sources.postings import AS_OF, postings
from ..sources.tables import read_columns, read_table
from .registry import register

_LI_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@register("keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       strftime(l_shipdate, '%Y-%m-%d') AS ship_day
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def q_keep_first(spark, sf):
    li = read_columns(spark, sf, "lineitem", _LI_COLS + ["l_shipdate"])
    out = dedup.keep_first(li, ["l_orderkey", "l_linenumber"],
                           ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return out.select(*_LI_COLS, F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"))


@register("incremental_dedup", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def q_incremental_dedup(spark, sf):
    orders = read_columns(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    li = read_columns(spark, sf, "lineitem", ["l_orderkey"])
    return dedup.drop_existing(orders, li, "o_orderkey", "l_orderkey")


@register("duplicate_keys", """
WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, d.n FROM lineitem l JOIN d USING (l_orderkey, l_linenumber)""")
def q_duplicate_keys(spark, sf):
    li = read_columns(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"])
    return dedup.duplicate_keys(li, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "n")


_DESC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("describe_numeric", " UNION ALL ".join(f"""
SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
       round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM lineitem""" for c in _DESC_COLS))
def q_describe_numeric(spark, sf):
    li = read_columns(spark, sf, "lineitem", _DESC_COLS)
    d = profile.describe(li, _DESC_COLS)
    return d.select("column", "count", *[F.round(c, 6).alias(c) for c in
                                         ("mean", "std", "min", "q25", "q50", "q75", "max")])


_NULL_COLS = ["id", "job_title", "employer_name", "city", "technologies_used", "expiration", "date_posted"]


@register("null_profile", "WITH prof AS (SELECT " + ", ".join(
    [f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _NULL_COLS] +
    ["count(*) FILTER (WHERE exp_parsed IS NULL) AS exp_parsed",
     "count(*) FILTER (WHERE start_parsed IS NULL) AS start_parsed"]) +
    """ FROM (SELECT *, (CASE WHEN expiration_raw = 'N/A' THEN NULL ELSE 1 END) AS exp_parsed,
                     (CASE WHEN salary_raw LIKE '%–%' THEN 1 END) AS start_parsed FROM pv))
SELECT "column", nulls, nulls > 0 AS has_null FROM prof UNPIVOT (nulls FOR "column" IN (""" +
    ", ".join(_NULL_COLS + ["exp_parsed", "start_parsed"]) + "))", pv=True)
def q_null_profile(spark, sf):
    pv = postings(spark, sf)
    pv = pv.select(*_NULL_COLS, parse.parse_expiration("expiration_raw", AS_OF).alias("exp_parsed"),
                   parse.parse_salary("salary_raw")["start_salary"].alias("start_parsed"))
    return profile.null_profile(pv)


@register("run_report", """
SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS distinct_keys, count(*) = 0 AS is_empty,
       (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS rows_after_dedup
FROM orders""")
def q_run_report(spark, sf):
    orders = read_columns(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    fresh = dedup.drop_existing(orders, read_columns(spark, sf, "lineitem", ["l_orderkey"]), "o_orderkey", "l_orderkey")
    return profile.run_report(orders, "o_orderkey", fresh)


@register("report_latest_key", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS generation_id FROM events
WHERE strftime(CAST(ts AS DATE), '%Y-%m-%d') <> '2024-01-30'
ORDER BY generation_id DESC LIMIT 1""")
def q_report_latest_key(spark, sf):
    from ..operators import facets
    days = read_table(spark, sf, "events").select(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("generation_id"))
    return facets.latest_other_key(days, "generation_id", "2024-01-30")
