"""Registered queries for the scalar rules (parsers, text, flags), applied to
whole columns of the postings view or the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, parse, text
from ..mappings import (BENEFIT_CATEGORIES, CONTRACT_COLUMNS, CONTRACT_LABELS,
                        CONTRACT_VALUES, JOB_LEVELS, LANGUAGE_KEYWORDS, LEVEL_TERMS, POLISH_MONTHS,
                        WORK_TYPE_KEYWORDS)
from ..sources.postings import AS_OF, postings
from ..sources.tables import read_table
from .registry import register


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(values) -> str:
    return "[" + ", ".join(_sql_str(v) for v in values) + "]"


def _r6(df, keep=("id",)):
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------------ C1
def _months_sql(expr: str) -> str:
    out = expr
    for pl, en in POLISH_MONTHS.items():
        out = f"replace({out}, {_sql_str(pl)}, {_sql_str(en)})"
    return out


@register("parse_expiration", f"""
WITH s AS (SELECT id, trim(regexp_replace(regexp_replace(lower(expiration_raw), '\\b(do|to)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS t
           FROM pv)
SELECT id, strftime(coalesce(
  CASE WHEN regexp_full_match(t, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}') THEN CAST(try_strptime(t, '%d.%m.%Y') AS DATE) END,
  CASE WHEN regexp_matches(t, '(\\d+)\\s*(dni|days)')
       THEN CAST(DATE '{AS_OF}' + CAST(regexp_extract(t, '(\\d+)\\s*(dni|days)', 1) AS INTEGER) - 1 AS DATE) END,
  CASE WHEN regexp_full_match({_months_sql('t')}, '\\d{{1,2}} [A-Za-z]+ \\d{{4}}')
       THEN CAST(try_strptime({_months_sql('t')}, '%d %B %Y') AS DATE) END), '%Y-%m-%d') AS expiration
FROM s""", pv=True)
def q_parse_expiration(spark, sf):
    pv = postings(spark, sf)
    return pv.select("id", F.date_format(parse.parse_expiration("expiration_raw", AS_OF), "yyyy-MM-dd")
                     .alias("expiration"))


# ------------------------------------------------------------------ C4
_SALARY_SQL = """
WITH s1 AS (SELECT id, regexp_replace(regexp_replace(replace(salary_raw, ',', ' '), '(\\d)\\s+(\\d)', '\\1\\2', 'g'),
                                      '\\s+', ' ', 'g') AS s FROM pv),
s2 AS (SELECT id, trim(s) AS s, strpos(trim(s), '–') AS dash FROM s1),
s3 AS (SELECT id, s, dash,
              CASE WHEN dash > 0 THEN trim(substr(s, 1, dash - 1)) END AS first,
              CASE WHEN dash > 0 THEN string_split(trim(substr(s, dash + 1)), ' ')[1] END AS second FROM s2),
s4 AS (SELECT id, s, dash, second,
              CASE WHEN first = '' THEN 0.0 WHEN regexp_replace(first, '\\D', '', 'g') = '' THEN NULL
                   ELSE CAST(regexp_replace(first, '\\D', '', 'g') AS DOUBLE) END AS lo,
              CASE WHEN second = '' THEN 0.0 WHEN regexp_replace(second, '\\D', '', 'g') = '' THEN NULL
                   ELSE CAST(regexp_replace(second, '\\D', '', 'g') AS DOUBLE) END AS hi,
              contains(lower(s), 'net') AS net FROM s3),
s5 AS (SELECT *, ((lo <> 0 AND lo < 1000) OR (hi <> 0 AND hi < 1000)) AS hourly,
              CASE WHEN net AND lo <> 0 THEN lo / CAST(0.77 AS DOUBLE) ELSE lo END AS lo_n,
              CASE WHEN net AND hi <> 0 THEN hi / CAST(0.77 AS DOUBLE) ELSE hi END AS hi_n,
              (s IS NOT NULL AND dash > 0 AND second <> '' AND lo IS NOT NULL AND hi IS NOT NULL) AS valid FROM s4)
SELECT id,
  round(CASE WHEN valid THEN CASE WHEN hourly AND lo_n <> 0 AND lo_n < 1000 THEN lo_n * 160 ELSE lo_n END END, 6) AS start_salary,
  round(CASE WHEN valid THEN CASE WHEN hourly AND hi_n <> 0 AND hi_n < 1000 THEN hi_n * 160 ELSE hi_n END END, 6) AS max_salary
FROM s5"""


@register("parse_salary", _SALARY_SQL, pv=True)
def q_parse_salary(spark, sf):
    pv = postings(spark, sf)
    sal = parse.parse_salary("salary_raw")
    return _r6(pv.select("id", sal["start_salary"].alias("start_salary"), sal["max_salary"].alias("max_salary")))


# ------------------------------------------------------------------ C3
@register("work_type_location", """
SELECT id, coalesce(list_filter(list_transform(string_split(location_raw, ','), lambda p:
          CASE WHEN contains(lower(p), '"100% time"') THEN 'Remote'
               WHEN regexp_matches(lower(p), '(70|50|40|30|20)') THEN 'Hybrid' END),
        lambda x: x IS NOT NULL)[-1], 'Full Time') AS work_type
FROM pv""", pv=True)
def q_work_type_location(spark, sf):
    pv = postings(spark, sf)
    return pv.select("id", parse.work_type_from_location("location_raw").alias("work_type"))


# ------------------------------------------------------ P5-P13 projection
@register("curated_projection", """
SELECT id AS ID,
       CAST(id AS VARCHAR) || '_' || employer_name || '_' || city || '_' || strftime(expiration, '%Y-%m-%d') AS NaturalKey,
       round(coalesce(TRY_CAST(split_part(replace(lat, ',', '.'), ';', 1) AS DOUBLE), 0.0), 6) AS Latitude,
       round(coalesce(TRY_CAST(split_part(replace(long, ',', '.'), ';', 1) AS DOUBLE), 0.0), 6) AS Longitude,
       round(coalesce((start_salary + max_salary) / 2, 0.0), 6) AS MidSalary,
       replace(coalesce(nullif(CASE WHEN id % 5 = 0 THEN 'N/A' WHEN id % 5 = 1 THEN NULL ELSE 'hybrid work • remote work' END, 'N/A'),
                        'Full Time'), ' • ', ',') AS WorkMode,
       coalesce(nullif(CASE WHEN technologies_used = 'N/A' THEN '' ELSE technologies_used END, ''), 'N/A') AS Technologies,
       array_to_string(list_transform(string_split(technologies_used, ';'), lambda x: trim(x)), ';') AS TechTrimmed
FROM pv""", pv=True)
def q_curated_projection(spark, sf):
    pv = postings(spark, sf)
    mode = (F.when(F.col("id") % 5 == 0, F.lit("N/A")).when(F.col("id") % 5 == 1, F.lit(None))
            .otherwise(F.lit("hybrid work • remote work")))
    tech = F.when(F.col("technologies_used") == "N/A", F.lit("")).otherwise(F.col("technologies_used"))
    out = pv.select(
        F.col("id").alias("ID"),
        parse.natural_key(["id", "employer_name", "city", F.date_format("expiration", "yyyy-MM-dd")]).alias("NaturalKey"),
        parse.first_coordinate("lat").alias("Latitude"),
        parse.first_coordinate("long").alias("Longitude"),
        parse.mid_value("start_salary", "max_salary").alias("MidSalary"),
        parse.null_cascade(mode, F.lit("Full Time")).alias("WorkMode"),
        parse.sentinel_default(tech).alias("Technologies"),
        parse.trim_join(F.split("technologies_used", ";")).alias("TechTrimmed"),
    )
    return _r6(out)


# ------------------------------------------------------------------ C10
_ROLE_INPUT_SQL = ("CASE id % 4 WHEN 0 THEN 'Senior ' || job_title || ' (m/f)' "
                   "WHEN 1 THEN 'junior ' || job_title || ' with ' || core_role "
                   "WHEN 2 THEN job_title || ' engineer [' || core_role || '] in ' || city "
                   "ELSE 'Team Lead ' || job_title || ' | remote' END")


def _role_input():
    i = F.col("id") % 4
    jt, cr = F.col("job_title"), F.col("core_role")
    return (F.when(i == 0, F.concat(F.lit("Senior "), jt, F.lit(" (m/f)")))
            .when(i == 1, F.concat(F.lit("junior "), jt, F.lit(" with "), cr))
            .when(i == 2, F.concat(jt, F.lit(" engineer ["), cr, F.lit("] in "), F.col("city")))
            .otherwise(F.concat(F.lit("Team Lead "), jt, F.lit(" | remote"))))


_LEVEL_ALT = "|".join(sorted(LEVEL_TERMS, key=lambda w: (-len(w), w)))
_ROLE_CLEAN_SQL = f"""
WITH r AS (SELECT id, {_ROLE_INPUT_SQL} AS title FROM pv),
c AS (SELECT id, title, trim(regexp_replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          regexp_replace(lower(title), '\\b({_LEVEL_ALT})\\b', '', 'g'),
          '(?i)\\bin\\b.*', ''), '\\[.*?\\]|\\(.*?\\)', '', 'g'), ' with.*', ''), '[|\\\\].*', ''),
        '\\s+', ' ', 'g')) AS s FROM r)
SELECT id, title,
  array_to_string(list_transform(string_split(s, ' '), lambda w:
     CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS role
FROM c"""


@register("role_clean", _ROLE_CLEAN_SQL, pv=True)
def q_role_clean(spark, sf):
    pv = postings(spark, sf).select("id", _role_input().alias("title"))
    return pv.select("id", "title", text.clean_role("title").alias("role"))


# ------------------------------------------------------------------ C13
_EMP_INPUT_SQL = ("replace(employer_name, 'Customer#', 'acme ') || CASE id % 4 WHEN 0 THEN ' Sp. z o.o.' "
                  "WHEN 1 THEN ' S.A.' WHEN 2 THEN ' Poland ltd.' ELSE ' [IT] GmbH' END")


def _employer_input():
    tail = (F.when(F.col("id") % 4 == 0, F.lit(" Sp. z o.o.")).when(F.col("id") % 4 == 1, F.lit(" S.A."))
            .when(F.col("id") % 4 == 2, F.lit(" Poland ltd.")).otherwise(F.lit(" [IT] GmbH")))
    return F.concat(F.replace(F.col("employer_name"), F.lit("Customer#"), F.lit("acme ")), tail)


_EMP_SQL = f"""
WITH e AS (SELECT id, {_EMP_INPUT_SQL} AS raw FROM pv),
c AS (SELECT id, raw, trim(replace(regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(raw, '(?i){text.LEGAL_FORMS}', '', 'g'), '(?i){text.COUNTRY_WORDS}', '', 'g'),
        '\\.\\s*|^\\s*|\\s+$', ' ', 'g'), '\\s+', ' ', 'g'), '()', '')) AS s FROM e)
SELECT id, raw, array_to_string(list_transform(string_split(s, ' '), lambda w:
     CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS employer
FROM c"""


@register("employer_normalise", _EMP_SQL, pv=True)
def q_employer_normalise(spark, sf):
    pv = postings(spark, sf).select("id", _employer_input().alias("raw"))
    return pv.select("id", "raw", text.normalise_employer("raw").alias("employer"))


# ------------------------------------------------------------------ C11/C12
_TR_WORDS = ["młodszy", "Analityk", "programista", "inżynier", "Specjalista", "programistka"]


def _translate_input():
    arr = F.array(*[F.lit(w) for w in _TR_WORDS])
    return F.concat(F.lit("▁"), F.element_at(arr, (F.col("id") % len(_TR_WORDS) + 1).cast("int")),
                    F.lit("▁"), F.col("job_title"), F.lit(" technik serwisu▁"))


def _translate_sql():
    single = {k.lower(): v for k, v in __import__("hirelens.mappings", fromlist=["x"]).TRANSLATION.items() if " " not in k}
    multi = {k.lower(): v for k, v in __import__("hirelens.mappings", fromlist=["x"]).TRANSLATION.items() if " " in k}
    keys = _sql_list(single.keys())
    vals = _sql_list(single.values())
    inp = (f"'▁' || {_sql_list(_TR_WORDS)}[id % {len(_TR_WORDS)} + 1] || '▁' || job_title || ' technik serwisu▁'")
    s = "replace(regexp_replace(raw, '^▁+|▁+$', '', 'g'), '▁', ' ')"
    t = "stripped"
    for k, v in multi.items():
        t = f"regexp_replace({t}, '(?i)(^|\\s){k}(\\s|$)', '\\1{v}\\2', 'g')"
    return f"""
WITH i AS (SELECT id, {inp} AS raw FROM pv),
s AS (SELECT id, raw, {s} AS stripped FROM i),
m AS (SELECT id, raw, stripped, trim(regexp_replace({t}, '\\s+', ' ', 'g')) AS t FROM s)
SELECT id, raw, stripped,
  array_to_string(list_transform(string_split(t, ' '), lambda w:
     CASE WHEN list_position({keys}, lower(w)) IS NOT NULL THEN {vals}[list_position({keys}, lower(w))] ELSE w END), ' ') AS translated
FROM m"""


@register("word_translate", _translate_sql(), pv=True)
def q_word_translate(spark, sf):
    pv = postings(spark, sf).select("id", _translate_input().alias("raw"))
    st = pv.withColumn("stripped", text.strip_subword_marks("raw"))
    return st.select("id", "raw", "stripped", text.translate_words("stripped").alias("translated"))


# ------------------------------------------------------------------ J6/C8
_CONTRACT_INPUTS = list(CONTRACT_VALUES) + ["B2B contract (full-time)", "freelance"]
_LEVEL_INPUTS = list(JOB_LEVELS) + ["unknown level"]


def _pick(values, salt: int):
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, ((F.col("id") + salt) % len(values) + 1).cast("int"))


def _pick_sql(values, salt: int) -> str:
    return f"{_sql_list(values)}[(id + {salt}) % {len(values)} + 1]"


def _map_sql(expr: str, mapping: dict, keep: bool) -> str:
    keys, vals = _sql_list(mapping.keys()), _sql_list(mapping.values())
    hit = f"{vals}[list_position({keys}, {expr})]"
    return f"coalesce({hit}, {expr})" if keep else hit


def _flags_sql(expr: str) -> str:
    v = (f"replace(regexp_replace({expr}, '\\s*\\([^()]*\\)\\s*$', ''), 'Internship, Apprenticeship Contract', "
         f"'Internship / Apprenticeship Contract')")
    return ", ".join(f"CAST(coalesce(list_contains(string_split({v}, ', '), {_sql_str(lab)}), false) AS INTEGER) AS {n}"
                     for lab, n in zip(CONTRACT_LABELS, CONTRACT_COLUMNS))


@register("category_standardise", f"""
WITH i AS (SELECT id, {_pick_sql(_CONTRACT_INPUTS, 0)} AS contract_raw, {_pick_sql(_LEVEL_INPUTS, 7)} AS level_raw FROM pv)
SELECT id, contract_raw, level_raw, {_map_sql('contract_raw', CONTRACT_VALUES, True)} AS contract,
       {_map_sql('level_raw', JOB_LEVELS, False)} AS level FROM i""", pv=True)
def q_category_standardise(spark, sf):
    pv = postings(spark, sf).select("id", _pick(_CONTRACT_INPUTS, 0).alias("contract_raw"),
                                    _pick(_LEVEL_INPUTS, 7).alias("level_raw"))
    return pv.select("id", "contract_raw", "level_raw", classify.standardise("contract_raw").alias("contract"),
                     classify.job_level("level_raw").alias("level"))


@register("category_flags", f"""
WITH i AS (SELECT id, {_map_sql(_pick_sql(_CONTRACT_INPUTS, 0), CONTRACT_VALUES, True)} AS contract FROM pv)
SELECT id, contract, {_flags_sql('contract')} FROM i""", pv=True)
def q_category_flags(spark, sf):
    pv = postings(spark, sf).select("id", classify.standardise(_pick(_CONTRACT_INPUTS, 0)).alias("contract"))
    return pv.select("id", "contract", *classify.token_flags("contract"))


# ------------------------------------------------------------------ C6/C7/C9
def _kw_sql(text_expr: str, categories: dict) -> str:
    cols = []
    for name, kws in categories.items():
        ors = " OR ".join(f"contains({text_expr}, {_sql_str(k.lower())})" for k in dict.fromkeys(k.lower() for k in kws))
        cols.append(f"CAST(coalesce({ors}, false) AS INTEGER) AS {name}")
    return ", ".join(cols)


@register("keyword_flags", f"""
SELECT doc_id, {_kw_sql('lower(text)', BENEFIT_CATEGORIES)}, {_kw_sql('lower(text)', LANGUAGE_KEYWORDS)},
       {_kw_sql('lower(text)', WORK_TYPE_KEYWORDS)}
FROM documents""")
def q_keyword_flags(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", *classify.benefit_flags("text"), *classify.language_flags(["text"]),
                       *classify.work_type_flags("text"))


# ------------------------------------------------------------------ C15
def _lang_sql() -> str:
    toks = "regexp_split_to_array(lower(text), '[^\\p{L}]+')"
    structs = ", ".join(
        f"{{'hits': len(list_filter({toks}, lambda t: list_contains({_sql_list(ws)}, t))), 'neg_idx': {-i}, "
        f"'lang': {_sql_str(lang)}}}" for i, (lang, ws) in enumerate(classify.FUNCTION_WORDS.items()))
    return f"""
WITH b AS (SELECT doc_id, lang AS given, text, greatest({structs}) AS best FROM documents),
t AS (SELECT doc_id, given, CASE WHEN text IS NULL THEN 'en' WHEN regexp_matches(lower(text), '{classify.POLISH_LETTERS}') THEN 'pl'
                   WHEN best.hits > 0 THEN best.lang ELSE 'en' END AS tag FROM b)
SELECT doc_id, given, tag, CASE WHEN tag IN ('pl', 'en') THEN tag ELSE 'en' END AS source_tag FROM t"""


@register("language_tag", _lang_sql())
def q_language_tag(spark, sf):
    docs = read_table(spark, sf, "documents")
    tagged = docs.select("doc_id", F.col("lang").alias("given"),
                         classify.language_tag("text", reduce_to=None).alias("tag"))
    # the source's pl/en reduction of the same tag (one detection pass)
    return tagged.withColumn("source_tag", F.when(F.col("tag").isin("pl", "en"), F.col("tag")).otherwise(F.lit("en")))


# ------------------------------------------------------------------ C17-C20
@register("text_clean", """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
   '(https|http)?:\\/\\/([\\p{L}\\p{N}_]|\\.|\\/|\\?|\\=|\\&|\\%)*\\b', '', 'g'),
   '[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}]+', '', 'g'),
   '[^a-zA-Z0-9]+', ' ', 'g'), ' +', ' ', 'g') AS cleaned
FROM documents""")
def q_text_clean(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", text.clean_text("text").alias("cleaned"))
