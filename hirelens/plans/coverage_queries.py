"""Registered queries for readers, shapers and filters that no other query
runs (S2, S5, F3, F6, F7, P2, P9, P14, A6 benefits, C16, C23, C26, C28, C29,
V1, ST2, T4 nearest), each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, parse, text
from ..mappings import BENEFIT_CATEGORIES, BENEFIT_COLUMNS
from ..operators import facets, filters, shaping, subscriptions as subs_ops
from ..session import stored
from ..sources import dims
from ..sources.postings import AS_OF, postings
from ..sources.tables import lookup_key, read_columns, read_staging, read_table
from ..streaming import ingest
from .registry import register
from .rule_queries import _kw_sql, _pick, _pick_sql, _translate_input, _translate_sql
from .subscription_queries import _MATCH_CTE, DUE_MINUTE, LOOKBACK, _parsed_subs, stored_subs, window_view


# ------------------------------------------------------------------- S2 / S5
_CAP = 1000  # the reader's own cap on a staging batch


@register("staging_batch", f"""
SELECT 'all' AS batch, o_orderkey, o_custkey, o_orderstatus FROM orders
UNION ALL SELECT * FROM (SELECT 'capped', o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT {_CAP})""")
def q_staging_batch(spark, sf):
    orders = read_columns(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    every, capped = read_staging(orders, "o_orderkey"), read_staging(orders, "o_orderkey", _CAP)
    return every.select(F.lit("all").alias("batch"), "*").unionByName(capped.select(F.lit("capped").alias("batch"), "*"))


_DAY_SQL = "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS generation_id, count(*) AS n FROM events GROUP BY 1"


def _day_report(spark, sf):
    days = read_table(spark, sf, "events").select(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("generation_id"))
    return days.groupBy("generation_id").agg(F.count(F.lit(1)).alias("n"))


@register("report_lookup", f"SELECT * FROM ({_DAY_SQL}) WHERE generation_id = '2024-01-05'")
def q_report_lookup(spark, sf):
    return lookup_key(_day_report(spark, sf), "generation_id", "2024-01-05")


@register("report_nearest_key", f"""
SELECT generation_id FROM ({_DAY_SQL}) WHERE generation_id <> '2024-01-07'
ORDER BY abs(date_diff('day', CAST(generation_id AS DATE), DATE '2024-01-07')), generation_id DESC LIMIT 1""")
def q_report_nearest_key(spark, sf):
    return facets.nearest_other_date(_day_report(spark, sf), "generation_id", "2024-01-07")


# ------------------------------------------------------------------- F3 / F6 / F7
@register("member_filter", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_member_filter(spark, sf):
    orders = read_columns(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    building = read_columns(spark, sf, "customer", ["c_custkey", "c_mktsegment"]).filter("c_mktsegment = 'BUILDING'")
    some = filters.member_of(orders, "o_orderpriority", ["1-URGENT", "5-LOW"])
    return filters.member_of(some, "o_custkey", building.select("c_custkey")).select("o_orderkey", "o_orderpriority")


_ROLE_SPEC = {"region": "asia;EUR", "core_role": "MEDIUM;LARGE", "employer_name": ""}


@register("region_role_filter", """
SELECT id, region, core_role FROM pv
WHERE (contains(lower(region), 'asia') OR contains(lower(region), 'eur'))
  AND (contains(core_role, 'MEDIUM') OR contains(core_role, 'LARGE'))""", pv=True)
def q_region_role_filter(spark, sf):
    return filters.apply_filters(postings(spark, sf), _ROLE_SPEC, AS_OF).select("id", "region", "core_role")


# ------------------------------------------------------------------- P2 / P9 / P14
@register("rename_known", """
SELECT id, technologies_used, 'ship' AS worker_responsibilities, job_title AS job_requirements FROM pv""", pv=True)
def q_rename_known(spark, sf):
    raw = postings(spark, sf).select("id", F.col("technologies_used").alias("technologies"),
                                     F.lit("ship").alias("responsibilities"), F.col("job_title").alias("requirements"))
    return shaping.rename_known(raw)


_FLAG_SQL = "['TRUE', 'false', '1', '0', 'x', NULL][o_custkey % 6 + 1]"


@register("flags_to_int", f"""
SELECT o_orderkey, {_FLAG_SQL} AS note,
       CAST(CASE WHEN o_custkey % 6 IN (0, 2) THEN 1 WHEN o_custkey % 6 IN (1, 3) THEN 0 END AS INTEGER) AS text_flag,
       CAST(o_orderstatus = 'F' AS INTEGER) AS bool_flag FROM orders""")
def q_flags_to_int(spark, sf):
    words = F.array(*[F.lit(x) for x in ("TRUE", "false", "1", "0", "x")], F.lit(None).cast("string"))
    word = F.element_at(words, (F.col("o_custkey") % 6 + 1).cast("int"))
    df = read_table(spark, sf, "orders").select("o_orderkey", word.alias("note"), word.alias("text_flag"),
                                                (F.col("o_orderstatus") == "F").alias("bool_flag"))
    return shaping.flags_to_int(df, ["text_flag", "bool_flag"])


@register("provenance", """
SELECT page_id, '1998-08-01' AS date_posted, '1998-08-01 00:00:00_site_a' AS upload_id FROM pages""")
def q_provenance(spark, sf):
    out = shaping.with_provenance(read_columns(spark, sf, "pages", ["page_id"]), AS_OF, "site_a")
    return out.withColumn("date_posted", F.date_format("date_posted", "yyyy-MM-dd"))


# ------------------------------------------------------------------- C26 / C29 / C23
@register("salary_texts", """
SELECT p_partkey, trim(concat_ws(' ', CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey AS VARCHAR) END, 'PLN',
         CASE WHEN p_partkey % 2 = 0 THEN p_brand END)) AS one,
       CAST(p_partkey AS VARCHAR) || ' (' || p_brand || ') / ' || p_name || ' (B2B)' AS several FROM part""")
def q_salary_texts(spark, sf):
    key = F.col("p_partkey").cast("string")
    return read_table(spark, sf, "part").select(
        "p_partkey", parse.salary_text(F.when(F.col("p_partkey") % 3 > 0, key), F.lit("PLN"),
                                       F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))).alias("one"),
        parse.offers_text(F.array(key, "p_name"), F.array("p_brand", F.lit("B2B"))).alias("several"))


@register("positional_fields", """
WITH a AS (SELECT id, string_split('exp ' || id || ';' || core_role || ';skip;' || employer_name || ';' || city, ';')[1:(id % 8)] AS f FROM pv)
SELECT id, coalesce(f[1], 'N/A') AS expiration, coalesce(f[2], 'N/A') AS experience_level, coalesce(f[4], 'N/A') AS contract_type,
       CASE WHEN len(f) > 4 THEN array_to_string(f[5:], ';') ELSE 'N/A' END AS location FROM a""", pv=True)
def q_positional_fields(spark, sf):
    i = F.col("id")
    fields = F.split(F.concat(F.lit("exp "), i.cast("string"), F.lit(";"), "core_role", F.lit(";skip;"), "employer_name",
                              F.lit(";"), "city"), ";")
    return (postings(spark, sf).select("id", F.slice(fields, F.lit(1), (i % 8).cast("int")).alias("f"))
            .select("id", parse.positional_fields("f").alias("p")).select("id", "p.*"))


@register("member_lists", """
WITH r AS (SELECT id, city || ';' || region || ';' || city AS list FROM pv)
SELECT id, array_to_string(list_filter(string_split(list, ';'),
         lambda x, i: list_position(string_split(list, ';'), x) = i), ';') AS members,
       len(regexp_split_to_array(list, '[,;]')) AS parts, trim(list) AS trimmed FROM r""", pv=True)
def q_member_lists(spark, sf):
    r = postings(spark, sf).select("id", F.concat("city", F.lit(";"), "region", F.lit(";"), "city").alias("list"))
    return r.select("id", text.distinct_members("list").alias("members"),
                    F.size(text.split_multi("list")).cast("bigint").alias("parts"),
                    text.trim_unicode(F.concat(F.lit("  "), "list", F.lit("  "))).alias("trimmed"))


# ------------------------------------------------------------------- A6 benefits
_BENEFIT_TEXTS = ["Free coffee;Medical care", "Training budget;Car parking", "N/A", "Integration events;Remote work"]


@register("benefit_totals", f"""
WITH b AS (SELECT {_kw_sql(f"lower({_pick_sql(_BENEFIT_TEXTS, 0)})", BENEFIT_CATEGORIES)} FROM pv),
t AS (SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in BENEFIT_COLUMNS)} FROM b)
SELECT flag, total FROM t UNPIVOT (total FOR flag IN ({', '.join(BENEFIT_COLUMNS)}))""", pv=True)
def q_benefit_totals(spark, sf):
    texts = postings(spark, sf).select(_pick(_BENEFIT_TEXTS, 0).alias("benefits"))
    return facets.flag_totals(texts.select(*classify.benefit_flags("benefits")), BENEFIT_COLUMNS)


# ------------------------------------------------------------------- C16 / V1
@register("translate_polish", f"""
WITH tr AS ({_translate_sql()})
SELECT id, CASE WHEN id % 2 = 0 THEN 'pl' ELSE 'en' END AS tag,
       CASE WHEN id % 2 = 0 THEN translated ELSE stripped END AS translated FROM tr""", pv=True)
def q_translate_polish(spark, sf):
    pv = postings(spark, sf).select("id", _translate_input().alias("raw"),
                                    F.when(F.col("id") % 2 == 0, F.lit("pl")).otherwise(F.lit("en")).alias("tag"))
    st = pv.withColumn("stripped", text.strip_subword_marks("raw"))
    return st.select("id", "tag", classify.translate_when("stripped", F.col("tag")).alias("translated"))


def _shout():
    """A stand-in for a model: loaded once per worker, called per batch."""
    return lambda texts: [t.upper() + "!" for t in texts]


@register("text_transformer", """
SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN upper(p_name) || '!' END AS transformed FROM part""")
def q_text_transformer(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).alias("t"))
    return part.select("p_partkey", classify.make_text_transformer(_shout)("t").alias("transformed"))


# ------------------------------------------------------------------- C28 / ST2
@register("filter_documents", f"""WITH {dims.SUBSCRIPTIONS_SQL}
SELECT chat_id, city, company, language, notification_time FROM subs WHERE doc_state = 'ok'""")
def q_filter_documents(spark, sf):
    written = _parsed_subs(spark, sf).select("chat_id", subs_ops.encode_filters(F.col("spec")).alias("filters"))
    spec = F.col("spec")
    return subs_ops.parse_filters(written, "filters").select(
        "chat_id", *[spec[k].alias(k) for k in ("city", "company", "language", "notification_time")])


@register("due_digest", f"""WITH {_MATCH_CTE},
due AS (SELECT chat_id FROM ok WHERE notification_time = '{DUE_MINUTE}')
SELECT d.chat_id, count(m.id) AS n, '{DUE_MINUTE}' AS minute FROM due d LEFT JOIN matches m ON d.chat_id = m.chat_id
GROUP BY d.chat_id""", pv=True)
def q_due_digest(spark, sf):
    out = ingest.due_matches(window_view(spark, sf), stored_subs(spark, sf), DUE_MINUTE, AS_OF, LOOKBACK, keep=stored)
    return out.select("chat_id", "n", "minute")
