"""Derived postings view (PV): job-posting shaped rows built from the
TPC-H-like driver tables, one row per order.

Plan shape (checked with ``explain``): lineitem is joined to supplier and
part on their keys (sort-merge or AQE-chosen broadcast), the narrower first, dealt by
order, joined to the places (nation and region are 25 and 5 rows and are broadcast
explicitly) and then aggregated.  An order has a handful of lines, so aggregating them before the deal would
sort and pack nearly as many buffers as there are lines.  Two sets are collected, as each
costs a buffer per group: places (the regions are read off them) and (type, brand) pairs;
both are bounded by the number of nations and of such pairs, never by the data size.
Lists are read with field paths and ``sort_array``, which are compiled, not with lambdas,
which are interpreted.  The per-order aggregate comes out hash-partitioned on the order
key and is not shuffled again: ``orders`` get their customers first, while narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mappings import POLISH_MONTHS
from .tables import read_table

# Order priority -> level flag; market segment -> language flag.
PRIORITY_LEVEL = {"5-LOW": "internship", "4-NOT SPECIFIED": "junior", "3-MEDIUM": "middle",
                  "2-HIGH": "senior", "1-URGENT": "lead"}
SEGMENT_LANGUAGE = {"AUTOMOBILE": "language_english", "BUILDING": "language_german",
                    "FURNITURE": "language_french", "HOUSEHOLD": "language_spanish",
                    "MACHINERY": "language_chinese_mandarin"}
AS_OF = "1998-08-02"


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions.
    return (nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
            .select("n_nationkey", "n_name", "r_name"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PV of FIXTURES.md §2 (plus the raw text columns the parsers read)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = (li.join(supp, li.l_suppkey == supp.s_suppkey).drop("l_suppkey", "s_suppkey")
             .join(part, li.l_partkey == part.p_partkey).drop("l_partkey", "p_partkey"))
    dealt = lines.repartition("l_orderkey").join(F.broadcast(_geo(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))

    loc = F.struct(F.col("n_name").alias("city"), F.col("r_name").alias("region"),
                   (F.col("n_nationkey") + 0.5).alias("lat"),
                   (-F.col("n_nationkey") - 0.5).alias("long"))
    per_order = dealt.groupBy("l_orderkey").agg(
        F.min("p_name").alias("job_title"),
        F.min("p_type").alias("core_role"),
        F.sort_array(F.collect_set(loc)).alias("locs"),
        F.min("l_extendedprice").alias("min_price"),
        F.max("l_extendedprice").alias("max_price"),
        F.collect_set(F.struct(F.upper("p_type").alias("type"), F.upper("p_brand").alias("brand"))).alias("goods"),
        F.max(F.when(F.col("l_returnflag") == "N", 1).otherwise(0)).alias("full_time"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("hybrid"),
        F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("remote"),
        F.max("l_shipdate").alias("last_ship"),
    )
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    j = per_order.join(placed, per_order.l_orderkey == placed.o_orderkey)

    key = F.col("o_orderkey")
    exp = F.to_date("last_ship")
    posted = F.to_date("o_orderdate")
    lo = F.round("min_price").cast("bigint").cast("string")
    hi = F.round("max_price").cast("bigint").cast("string")
    lo_h = F.round(F.col("min_price") / 1000).cast("bigint").cast("string")
    hi_h = F.round(F.col("max_price") / 1000).cast("bigint").cast("string")
    salary_raw = (F.when(key % 4 == 0, F.concat(lo, F.lit(" – "), hi, F.lit(" zł brutto")))
                  .when(key % 4 == 1, F.concat(lo, F.lit(" – "), hi, F.lit(" zł netto")))
                  .when(key % 4 == 2, F.concat(lo_h, F.lit(" – "), hi_h, F.lit(" zł/h brutto")))
                  .otherwise(F.concat(lo, F.lit("-"), hi, F.lit(" zł"))))
    month_pl = F.element_at(F.array(*[F.lit(m) for m in POLISH_MONTHS]), F.month(exp))
    cust = F.col("o_custkey")
    expiration_raw = (F.when(cust % 4 == 0, F.concat(F.lit("do "), F.date_format(exp, "dd.MM.yyyy")))
                      .when(cust % 4 == 1, F.concat((key % 30 + 1).cast("string"), F.lit(" dni")))
                      .when(cust % 4 == 2, F.concat_ws(" ", F.dayofmonth(exp).cast("string"), month_pl,
                                                       F.year(exp).cast("string")))
                      .otherwise(F.lit("N/A")))
    cities = F.col("locs.city")
    location_raw = F.concat(F.array_join(cities, ", "),
                            F.when(key % 3 == 0, F.lit(" (50%)")).otherwise(F.lit("")))
    techs = F.sort_array(F.array_union("goods.type", "goods.brand"))
    paused = F.col("o_orderstatus") == "P"

    level_cols = [F.when(F.col("o_orderpriority") == p, 1).otherwise(0).alias(lvl)
                  for p, lvl in PRIORITY_LEVEL.items()]
    from ..mappings import LANGUAGE_COLUMNS
    seg_for = {v: k for k, v in SEGMENT_LANGUAGE.items()}
    lang_cols = [(F.when(F.col("c_mktsegment") == seg_for[c], 1).otherwise(0) if c in seg_for
                  else F.lit(0)).alias(c) for c in LANGUAGE_COLUMNS]
    return j.select(
        key.alias("id"),
        "job_title", "core_role",
        F.col("c_name").alias("employer_name"),
        F.array_join(cities, ";").alias("city"),
        F.array_join(F.sort_array(F.array_distinct("locs.region")), ";").alias("region"),
        F.array_join(F.col("locs.lat").cast("array<string>"), ";").alias("lat"),
        F.array_join(F.col("locs.long").cast("array<string>"), ";").alias("long"),
        "locs",
        F.when(paused, F.lit(0.0)).otherwise(F.col("min_price")).alias("start_salary"),
        F.when(paused, F.lit(0.0)).otherwise(F.col("max_price")).alias("max_salary"),
        F.when(key % 10 == 0, F.lit("N/A")).otherwise(F.array_join(techs, ";")).alias("technologies_used"),
        *level_cols,
        "full_time", "hybrid", "remote",
        *lang_cols,
        exp.alias("expiration"),
        posted.alias("date_posted"),
        F.concat(F.date_format(posted, "yyyy-MM-dd"), F.lit("_site"), (key % 3).cast("string")).alias("upload_id"),
        F.concat(F.lit("https://jobs.example.org/offer/"), key.cast("string")).alias("url"),
        salary_raw.alias("salary_raw"),
        expiration_raw.alias("expiration_raw"),
        location_raw.alias("location_raw"),
    )


# DuckDB form of the same view, used by the oracle SQL of every PV query.
PV_SQL = r"""
pv_lines AS (
  SELECT l.l_orderkey, p.p_name, p.p_type, p.p_brand, l.l_extendedprice, l.l_returnflag, l.l_shipdate,
         n.n_nationkey, n.n_name, r.r_name
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
pv_agg AS (
  SELECT l_orderkey,
         min(p_name) AS job_title, min(p_type) AS core_role,
         list_sort(list_distinct(list({'city': n_name, 'region': r_name,
                                       'lat': n_nationkey + 0.5, 'long': -n_nationkey - 0.5}))) AS locs,
         list_sort(list_distinct(list(r_name))) AS regions,
         min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
         list_sort(list_distinct(list(upper(p_type)) || list(upper(p_brand)))) AS techs,
         max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS full_time,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hybrid,
         max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS remote,
         CAST(max(l_shipdate) AS DATE) AS expiration
  FROM pv_lines GROUP BY l_orderkey),
pv AS (
  SELECT o.o_orderkey AS id, a.job_title, a.core_role, c.c_name AS employer_name,
         array_to_string(list_transform(a.locs, lambda x: x.city), ';') AS city,
         array_to_string(a.regions, ';') AS region,
         array_to_string(list_transform(a.locs, lambda x: CAST(x.lat AS VARCHAR)), ';') AS lat,
         array_to_string(list_transform(a.locs, lambda x: CAST(x.long AS VARCHAR)), ';') AS long,
         a.locs,
         CASE WHEN o.o_orderstatus = 'P' THEN 0.0 ELSE a.min_price END AS start_salary,
         CASE WHEN o.o_orderstatus = 'P' THEN 0.0 ELSE a.max_price END AS max_salary,
         CASE WHEN o.o_orderkey % 10 = 0 THEN 'N/A' ELSE array_to_string(a.techs, ';') END AS technologies_used,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS internship,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS junior,
         CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS middle,
         CASE WHEN o.o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS senior,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS lead,
         a.full_time, a.hybrid, a.remote,
         CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS language_english,
         CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS language_german,
         CASE WHEN c.c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS language_french,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS language_spanish,
         0 AS language_italian, 0 AS language_dutch, 0 AS language_russian,
         CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS language_chinese_mandarin,
         0 AS language_japanese, 0 AS language_portuguese, 0 AS language_swedish, 0 AS language_danish,
         a.expiration,
         CAST(o.o_orderdate AS DATE) AS date_posted,
         strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') || '_site' || CAST(o.o_orderkey % 3 AS VARCHAR) AS upload_id,
         'https://jobs.example.org/offer/' || CAST(o.o_orderkey AS VARCHAR) AS url,
         CASE o.o_orderkey % 4
           WHEN 0 THEN CAST(CAST(round(a.min_price) AS BIGINT) AS VARCHAR) || ' – ' || CAST(CAST(round(a.max_price) AS BIGINT) AS VARCHAR) || ' zł brutto'
           WHEN 1 THEN CAST(CAST(round(a.min_price) AS BIGINT) AS VARCHAR) || ' – ' || CAST(CAST(round(a.max_price) AS BIGINT) AS VARCHAR) || ' zł netto'
           WHEN 2 THEN CAST(CAST(round(a.min_price / 1000) AS BIGINT) AS VARCHAR) || ' – ' || CAST(CAST(round(a.max_price / 1000) AS BIGINT) AS VARCHAR) || ' zł/h brutto'
           ELSE CAST(CAST(round(a.min_price) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(round(a.max_price) AS BIGINT) AS VARCHAR) || ' zł'
         END AS salary_raw,
         CASE o.o_custkey % 4
           WHEN 0 THEN 'do ' || strftime(a.expiration, '%d.%m.%Y')
           WHEN 1 THEN CAST(o.o_orderkey % 30 + 1 AS VARCHAR) || ' dni'
           WHEN 2 THEN CAST(day(a.expiration) AS VARCHAR) || ' ' ||
                       ['stycznia','lutego','marca','kwietnia','maja','czerwca','lipca','sierpnia',
                        'września','października','listopada','grudnia'][month(a.expiration)] || ' ' ||
                       CAST(year(a.expiration) AS VARCHAR)
           ELSE 'N/A'
         END AS expiration_raw,
         array_to_string(list_transform(a.locs, lambda x: x.city), ', ') ||
           CASE WHEN o.o_orderkey % 3 = 0 THEN ' (50%)' ELSE '' END AS location_raw
  FROM pv_agg a JOIN orders o ON a.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey)
"""
