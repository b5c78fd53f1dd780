"""Registered enrichment queries: gazetteer match, technology vocabulary and
enrichment, employer consolidation, nearest title."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..mappings import TECH_KEEP_SHORT, TECH_STOP
from ..operators import enrich
from ..sources import dims
from ..sources.postings import postings
from .registry import register
from .rule_queries import _ROLE_CLEAN_SQL, _role_input, _sql_list


# ------------------------------------------------------------ C2/J4/J5/A19
def _loc_input():
    return F.when(F.col("id") % 5 == 0, F.replace(F.col("location_raw"), F.lit("NATION_"), F.lit("Nation-"))) \
        .otherwise(F.col("location_raw"))


_GAZ_MATCH_SQL = f"""
WITH {dims.GAZETTEER_SQL},
i AS (SELECT id, CASE WHEN id % 5 = 0 THEN replace(location_raw, 'NATION_', 'Nation-') ELSE location_raw END AS loc FROM pv),
pieces AS (SELECT DISTINCT loc, lower(trim(piece)) AS p FROM (SELECT DISTINCT loc, unnest(string_split(loc, ',')) AS piece FROM i)),
dp AS (SELECT DISTINCT p FROM pieces),
nat AS (SELECT p, arg_min(city, gaz_order) AS n_city FROM dp JOIN gaz ON contains(p, lower(city)) GROUP BY p),
asc1 AS (SELECT p, arg_min(city_ascii, gaz_order) AS a_ascii FROM dp JOIN gaz ON contains(p, lower(city_ascii)) GROUP BY p),
ac AS (SELECT city_ascii, arg_min(city, gaz_order) AS a_city FROM gaz GROUP BY city_ascii),
m0 AS (SELECT dp.p, coalesce(nat.n_city, ac.a_city) AS city FROM dp LEFT JOIN nat ON dp.p = nat.p
       LEFT JOIN asc1 ON dp.p = asc1.p LEFT JOIN ac ON asc1.a_ascii = ac.city_ascii),
m AS (SELECT p, CASE WHEN city = 'Warsaw' THEN 'Warszawa' ELSE city END AS city FROM m0),
det AS (SELECT city, arg_min(admin_name, gaz_order) AS region, arg_min(lat, gaz_order) AS lat,
               arg_min(lng, gaz_order) AS lng FROM gaz GROUP BY city),
per AS (SELECT pieces.loc, m.city, det.region, det.lat, det.lng FROM pieces JOIN m ON pieces.p = m.p
        LEFT JOIN det ON m.city = det.city WHERE m.city IS NOT NULL),
agg AS (SELECT loc, list_sort(list_distinct(list({{'city': city, 'region': region, 'lat': lat, 'long': lng}}))) AS locs,
               list_sort(list_distinct(list(region))) AS regions FROM per GROUP BY loc)
SELECT i.id, i.loc,
  coalesce(array_to_string(list_transform(agg.locs, lambda x: x.city), ';'), 'Remote') AS city,
  coalesce(array_to_string(agg.regions, ';'), 'Remote') AS region,
  coalesce(array_to_string(list_transform(agg.locs, lambda x: coalesce(CAST(x.lat AS VARCHAR), 'None')), ';'), 'None') AS lat,
  coalesce(array_to_string(list_transform(agg.locs, lambda x: coalesce(CAST(x.long AS VARCHAR), 'None')), ';'), 'None') AS long,
  coalesce(list_filter(list_transform(string_split(i.loc, ','), lambda p:
          CASE WHEN contains(lower(p), '"100% time"') THEN 'Remote'
               WHEN regexp_matches(lower(p), '(70|50|40|30|20)') THEN 'Hybrid' END),
        lambda x: x IS NOT NULL)[-1], 'Full Time') AS work_type
FROM i LEFT JOIN agg ON i.loc = agg.loc"""


@register("gazetteer_match", _GAZ_MATCH_SQL, pv=True)
def q_gazetteer_match(spark, sf):
    pv = postings(spark, sf).select("id", _loc_input().alias("loc"))
    out = enrich.locate(pv, "loc", dims.gazetteer(spark, sf))
    return out.select("id", "loc", "city", "region", "lat", "long", "work_type")


# ------------------------------------------------------------------ A15/J7
_BATCH_CUT = "1998-01-01"


def _vocab(pv):
    batch = pv.filter(F.col("date_posted") >= F.lit(_BATCH_CUT).cast("date"))
    history = pv.filter((F.col("date_posted") < F.lit(_BATCH_CUT).cast("date")) | F.col("date_posted").isNull())
    return enrich.technology_vocabulary([(batch, "technologies_used"), (history, "technologies_used")])


_VOCAB_SQL = f"""vocab AS (
  SELECT DISTINCT trim(t) AS tech FROM (
    SELECT unnest(regexp_split_to_array(technologies_used, '[,;]')) AS t FROM pv
    WHERE technologies_used <> 'N/A' AND date_posted >= DATE '{_BATCH_CUT}'
    UNION ALL
    SELECT unnest(regexp_split_to_array(technologies_used, '[,;]')) AS t FROM pv
    WHERE technologies_used <> 'N/A' AND (date_posted < DATE '{_BATCH_CUT}' OR date_posted IS NULL))
  WHERE length(trim(t)) >= 2)"""


@register("vocabulary", f"WITH {_VOCAB_SQL} SELECT tech FROM vocab", pv=True)
def q_vocabulary(spark, sf):
    return _vocab(postings(spark, sf))


def _req():
    return F.concat(F.col("job_title"), F.lit(" and "), F.lower("core_role"), F.lit(", brand#"),
                    (F.col("id") % 30).cast("string"))


_TECH_SQL = f"""
WITH {_VOCAB_SQL},
elig AS (SELECT tech, lower(tech) AS tok FROM vocab
         WHERE (length(tech) > 2 OR list_contains({_sql_list(sorted(TECH_KEEP_SHORT))}, tech))
           AND NOT list_contains({_sql_list(sorted(TECH_STOP))}, tech)),
i AS (SELECT id, technologies_used, job_title,
             job_title || ' and ' || lower(core_role) || ', brand#' || CAST(id % 30 AS VARCHAR) AS req FROM pv),
raw AS (SELECT id, unnest(regexp_split_to_array(lower(job_title), '\\s+') || regexp_split_to_array(lower(req), '\\s+')) AS tok FROM i),
toks AS (SELECT DISTINCT id, regexp_replace(tok, '^[^\\p{{L}}\\p{{N}}+#.]+|[^\\p{{L}}\\p{{N}}+#.]+$', '', 'g') AS tok FROM raw),
found AS (SELECT id, list(DISTINCT tech) AS new FROM toks JOIN elig ON toks.tok = elig.tok WHERE toks.tok <> '' GROUP BY id),
m AS (SELECT i.id, list_sort(list_distinct(
        CASE WHEN technologies_used = 'N/A' THEN []::VARCHAR[] ELSE string_split(technologies_used, ';') END
        || coalesce(found.new, []::VARCHAR[]))) AS merged
      FROM i LEFT JOIN found ON i.id = found.id)
SELECT id, CASE WHEN len(merged) > 0 THEN array_to_string(merged, ';') ELSE 'N/A' END AS technologies_used FROM m"""


@register("technology_enrichment", _TECH_SQL, pv=True)
def q_technology_enrichment(spark, sf):
    pv = postings(spark, sf)
    rows = pv.select("id", "technologies_used", "job_title", _req().alias("req"))
    out = enrich.enrich_technologies(rows, "id", "technologies_used", ["job_title", "req"], _vocab(pv))
    return out.select("id", "technologies_used")


# --------------------------------------------------------------------- J8
def _employer_names():
    ck = F.substring("employer_name", 10, 20).cast("bigint")
    i = F.col("id") % 3
    return (F.when(i == 0, F.concat(F.lit("Acme "), (ck % 50).cast("string")))
            .when(i == 1, F.concat(F.lit("Acme "), (ck % 50).cast("string"), F.lit(" Labs")))
            .otherwise(F.concat(F.lit("Acme Group "), (ck % 500).cast("string"))))


_CONSOLIDATE_SQL = """
WITH i AS (SELECT id, CASE id % 3
             WHEN 0 THEN 'Acme ' || CAST(CAST(substr(employer_name, 10) AS BIGINT) % 50 AS VARCHAR)
             WHEN 1 THEN 'Acme ' || CAST(CAST(substr(employer_name, 10) AS BIGINT) % 50 AS VARCHAR) || ' Labs'
             ELSE 'Acme Group ' || CAST(CAST(substr(employer_name, 10) AS BIGINT) % 500 AS VARCHAR) END AS name FROM pv),
n AS (SELECT DISTINCT name FROM i WHERE name IS NOT NULL AND name <> ''),
c AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name <> b.name AND contains(b.name, a.name)
      QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY length(b.name) DESC, b.name) = 1)
SELECT i.id, i.name, coalesce(c.b, i.name) AS employer FROM i LEFT JOIN c ON i.name = c.a"""


@register("employer_consolidate", _CONSOLIDATE_SQL, pv=True)
def q_employer_consolidate(spark, sf):
    pv = postings(spark, sf).select("id", _employer_names().alias("name"))
    return enrich.consolidate(pv, "name", "employer").select("id", "name", "employer")


# ------------------------------------------------------------------ X1/J9
_NEAREST_SQL = f"""
WITH {dims.TITLES_SQL},
roles AS (SELECT id, role FROM ({_ROLE_CLEAN_SQL})),
q AS (SELECT DISTINCT role AS q FROM roles WHERE role IS NOT NULL),
nt AS (SELECT count(*) AS n FROM titles),
tt AS (SELECT idx, t, count(*) AS tf FROM (SELECT idx, unnest(regexp_extract_all(lower(title), '\\b\\w\\w+\\b')) AS t FROM titles) GROUP BY idx, t),
dft AS (SELECT t, count(*) AS df FROM tt GROUP BY t),
qt AS (SELECT q, t, count(*) AS qtf FROM (SELECT q, unnest(regexp_extract_all(lower(q), '\\b\\w\\w+\\b')) AS t FROM q) GROUP BY q, t),
pairs AS (SELECT DISTINCT qt.q, tt.idx FROM qt JOIN tt ON qt.t = tt.t),
tw AS (SELECT p.q, p.idx, tt.tf, dft.df, (qt.t IS NOT NULL) AS shared FROM pairs p JOIN tt ON p.idx = tt.idx
       JOIN dft ON tt.t = dft.t LEFT JOIN qt ON qt.q = p.q AND qt.t = tt.t),
tn AS (SELECT q, idx, sum(pow(tf * (ln((n + 2.0) / (df + CASE WHEN shared THEN 2 ELSE 1 END)) + 1), 2)) AS n2
       FROM tw, nt GROUP BY q, idx),
qn AS (SELECT qt.q, sum(pow(qtf * (ln((n + 2.0) / (coalesce(df, 0) + 2)) + 1), 2)) AS q2
       FROM qt LEFT JOIN dft ON qt.t = dft.t, nt GROUP BY qt.q),
dot AS (SELECT p.q, p.idx, sum(qt.qtf * tt.tf * pow(ln((n + 2.0) / (dft.df + 2)) + 1, 2)) AS d
        FROM pairs p JOIN qt ON qt.q = p.q JOIN tt ON tt.idx = p.idx AND tt.t = qt.t JOIN dft ON dft.t = qt.t, nt
        GROUP BY p.q, p.idx),
cs AS (SELECT dot.q, dot.idx, d / (sqrt(q2) * sqrt(n2)) AS c FROM dot JOIN qn ON dot.q = qn.q
       JOIN tn ON tn.q = dot.q AND tn.idx = dot.idx),
best AS (SELECT q, idx, c FROM cs QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(c, 12) DESC, idx) = 1)
SELECT r.id, r.role,
  CASE WHEN b.c > 0.7 THEN t.title ELSE array_to_string(list_transform(string_split(r.role, ' '), lambda w:
       upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END AS core_role,
  CASE WHEN b.c > 0.7 THEN round(b.c, 6) END AS score
FROM roles r LEFT JOIN best b ON r.role = b.q LEFT JOIN titles t ON t.idx = b.idx"""


@register("role_nearest_title", _NEAREST_SQL, pv=True)
def q_role_nearest_title(spark, sf):
    pv = postings(spark, sf).select("id", _role_input().alias("title"))
    roles = pv.select("id", text.clean_role("title").alias("role"))
    out = enrich.nearest_title(roles, "role", dims.titles(spark, sf))
    return out.select("id", "role", "core_role", F.round("_score", 6).alias("score"))
