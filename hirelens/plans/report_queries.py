"""Registered report queries over the postings view and the event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..mappings import LANGUAGE_COLUMNS, LEVEL_COLUMNS, WORK_TYPE_COLUMNS
from ..operators import facets
from ..sources.postings import AS_OF, postings
from ..sources.tables import read_table
from .registry import register


def _iso(col):
    return F.date_format(F.col(col), "yyyy-MM-dd")


@register("daily_counts", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n
FROM events GROUP BY 1 ORDER BY 1""")
def q_daily_counts(spark, sf):
    df = facets.daily_counts(read_table(spark, sf, "events"), "ts")
    return df.select(_iso("day").alias("day"), "n")


@register("monthly_counts", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n
FROM orders GROUP BY 1 ORDER BY 1""")
def q_monthly_counts(spark, sf):
    return facets.monthly_counts(read_table(spark, sf, "orders"), "o_orderdate")


@register("weekday_counts", """
WITH cal AS (SELECT * FROM (VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),
                                   (4,'Friday'),(5,'Saturday'),(6,'Sunday')) t(weekday_idx, weekday)),
c AS (SELECT isodow(ts) - 1 AS weekday_idx, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(cal.weekday_idx AS INTEGER) AS weekday_idx, cal.weekday, c.n
FROM cal LEFT JOIN c ON cal.weekday_idx = c.weekday_idx ORDER BY 1""")
def q_weekday_counts(spark, sf):
    return facets.weekday_counts(read_table(spark, sf, "events"), "ts")


@register("region_counts", """
SELECT name, count(*) AS n FROM (SELECT unnest(string_split(upper(region), ';')) AS name FROM pv)
GROUP BY name""", pv=True)
def q_region_counts(spark, sf):
    return facets.exploded_counts(postings(spark, sf), "region")


@register("region_choropleth", """
WITH dim AS (SELECT DISTINCT upper(r_name) AS name FROM region),
c AS (SELECT name, count(*) AS n FROM (SELECT unnest(string_split(upper(region), ';')) AS name FROM pv) GROUP BY name),
j AS (SELECT dim.name, coalesce(c.n, 0) AS n FROM dim LEFT JOIN c ON dim.name = c.name)
SELECT name, n, round(n / sum(n) OVER (), 6) AS share FROM j""", pv=True)
def q_region_choropleth(spark, sf):
    dim = read_table(spark, sf, "region").select(F.upper("r_name").alias("name"))
    counts = facets.exploded_counts(postings(spark, sf), "region")
    out = facets.with_share(facets.dimension_counts(dim, counts))
    return out.withColumn("share", F.round("share", 6))


_CITY_SQL = """
cities AS (
  SELECT unnest(string_split(CASE WHEN city = 'Warsaw' THEN 'Warszawa' ELSE city END, ';')) AS City,
         unnest(string_split(lat, ';')) AS Latitude, unnest(string_split(long, ';')) AS Longitude
  FROM pv
  WHERE len(string_split(city, ';')) = len(string_split(lat, ';'))
    AND len(string_split(city, ';')) = len(string_split(long, ';')))"""


@register("city_counts", f"""
WITH {_CITY_SQL}
SELECT City, count(*) AS Count FROM cities GROUP BY City""", pv=True)
def q_city_counts(spark, sf):
    return facets.city_counts(postings(spark, sf))


@register("city_bubbles", f"""
WITH {_CITY_SQL},
cnt AS (SELECT City, count(*) AS Count FROM cities GROUP BY City),
coords AS (SELECT DISTINCT City, Latitude, Longitude FROM cities),
d AS (SELECT cnt.City, cnt.Count, coords.Latitude, coords.Longitude FROM cnt LEFT JOIN coords ON cnt.City = coords.City
      WHERE coords.Latitude IS NOT NULL AND coords.Longitude IS NOT NULL),
s AS (SELECT min(Count) AS mn, max(Count) AS mx FROM d)
SELECT City, Count, Latitude, Longitude,
       round(CASE WHEN s.mx > s.mn THEN 10 + 30.0 * (Count - s.mn) / (s.mx - s.mn) ELSE 10.0 END, 6) AS Size
FROM d, s""", pv=True)
def q_city_bubbles(spark, sf):
    out = facets.city_bubbles(postings(spark, sf), 10.0, 40.0)
    return out.withColumn("Size", F.round("Size", 6))


@register("city_share_others", f"""
WITH {_CITY_SQL},
cnt AS (SELECT City, count(*) AS Count FROM cities GROUP BY City),
top AS (SELECT City FROM cnt ORDER BY Count DESC, City ASC LIMIT 9)
SELECT City, Count FROM cnt WHERE City IN (SELECT City FROM top)
UNION ALL
SELECT 'Others' AS City, CAST(coalesce(sum(Count), 0) AS BIGINT) AS Count FROM cnt WHERE City NOT IN (SELECT City FROM top)
""", pv=True)
def q_city_share_others(spark, sf):
    return facets.top_k_with_others(facets.city_counts(postings(spark, sf)), "City", "Count", 9)


_FLAGS = LANGUAGE_COLUMNS + LEVEL_COLUMNS + WORK_TYPE_COLUMNS


@register("flag_totals", "SELECT flag, total FROM (SELECT " + ", ".join(
    f"CAST(sum({f}) AS BIGINT) AS {f}" for f in _FLAGS) + " FROM pv) UNPIVOT (total FOR flag IN (" +
    ", ".join(_FLAGS) + "))", pv=True)
def q_flag_totals(spark, sf):
    return facets.flag_totals(postings(spark, sf), _FLAGS)


@register("top_roles", """
SELECT core_role AS value, count(*) AS n FROM pv GROUP BY 1 ORDER BY n DESC, value ASC LIMIT 30""", pv=True)
def q_top_roles(spark, sf):
    return facets.top_k(postings(spark, sf), "core_role", 30)


@register("top_employers", """
SELECT employer_name AS value, count(*) AS n FROM pv GROUP BY 1 ORDER BY n DESC, value ASC LIMIT 20""", pv=True)
def q_top_employers(spark, sf):
    return facets.top_k(postings(spark, sf), "employer_name", 20)


@register("top_technologies", """
SELECT technology, count(*) AS n FROM (
  SELECT upper(trim(unnest(regexp_split_to_array(technologies_used, '[,;]')))) AS technology FROM pv)
WHERE technology NOT IN ('', 'N/A')
GROUP BY 1 ORDER BY n DESC, technology ASC LIMIT 50""", pv=True)
def q_top_technologies(spark, sf):
    return facets.top_tokens(postings(spark, sf), "technologies_used", 50)


@register("top_cities_menu", """
SELECT value, count(*) AS n FROM (SELECT unnest(string_split(city, ';')) AS value FROM pv)
GROUP BY 1 ORDER BY n DESC, value ASC LIMIT 50""", pv=True)
def q_top_cities_menu(spark, sf):
    return facets.top_exploded(postings(spark, sf), "city", 50)


@register("kpis", f"""
SELECT count(*) FILTER (WHERE date_posted = DATE '{AS_OF}' - INTERVAL 1 DAY) AS posted_yesterday,
       count(*) FILTER (WHERE expiration > DATE '{AS_OF}') AS active_now,
       count(*) AS total FROM pv""", pv=True)
def q_kpis(spark, sf):
    return facets.kpis(postings(spark, sf), "date_posted", "expiration", AS_OF)


@register("date_bounds", """
SELECT strftime(min(date_posted), '%Y-%m-%d') AS min_date, strftime(max(date_posted), '%Y-%m-%d') AS max_date
FROM pv""", pv=True)
def q_date_bounds(spark, sf):
    df = facets.date_bounds(postings(spark, sf), "date_posted")
    return df.select(_iso("min_date").alias("min_date"), _iso("max_date").alias("max_date"))


def _box_sql() -> str:
    stack = " UNION ALL ".join(
        f"SELECT '{l}' AS level, start_salary AS s, max_salary AS m FROM pv WHERE {l} = 1 AND start_salary <> 0"
        for l in LEVEL_COLUMNS)
    parts = []
    for name, c in (("start", "s"), ("max", "m"), ("mid", "mid")):
        parts += [f"round(quantile_cont({c}, 0.25), 6) AS {name}_q1",
                  f"round(quantile_cont({c}, 0.5), 6) AS {name}_median",
                  f"round(quantile_cont({c}, 0.75), 6) AS {name}_q3",
                  f"round(avg({c}), 6) AS {name}_mean", f"round(stddev_samp({c}), 6) AS {name}_sd"]
    return f"""
WITH st AS ({stack}),
q AS (SELECT level, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.75) AS q3 FROM st GROUP BY level),
k AS (SELECT st.level, st.s, st.m, (st.s + st.m) / 2 AS mid FROM st JOIN q ON st.level = q.level
      WHERE st.s <= q.q3 + 10 * (q.q3 - q.q1))
SELECT level, count(*) AS n, {', '.join(parts)} FROM k GROUP BY level"""


@register("salary_box_stats", _box_sql(), pv=True)
def q_salary_box_stats(spark, sf):
    df = facets.salary_box_stats(postings(spark, sf), LEVEL_COLUMNS)
    return df.select([F.round(c, 6).alias(c) if c not in ("level", "n") else F.col(c) for c in df.columns])
