"""The daily report's facets in one pass (S16 with A1-A12).

What a posting has once (flags, indicators, number of places) is added up per day, one row
a day; what it has many of (regions, cities, technologies, its employer and role) is
expanded into (metric, key) rows, and one aggregate counts them, partially before
the shuffle. Neither uses lambdas, which Spark interprets row by row. A city of aligned
lists is one row for both city metrics. What
follows from other counts is derived from them, not counted again: months,
weekdays, bounds and totals from the days, "Others" from the total and the top
cities. Top lists are ranks limited per metric before rows meet (a metric
without a limit keeps one row a key and needs no rank), so no task holds all keys of a
metric. Salaries are counted per level and amount; ranks are running counts over the
distinct amounts of a level.

Reports of several parts of the same postings (all, those before a day) are counted
together: a count for each part beside the key, so each posting is expanded once.

A null member is no value; a metric with fixed members (weekdays, flags, indicators)
always has all of them. Plans read ``df`` three times, whatever the number of facets.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..mappings import WEEKDAYS
from .facets import _replace_whole

#: Metrics cut to their most frequent keys.
TOPS = {"top_employer": 20, "top_role": 30, "top_technology": 50, "top_city": 50}


#: One report over all postings: the count's name, and which postings it counts (None: all).
ALL: Mapping[str, Column | None] = {"n": None}


def _inside(parts: Mapping[str, Column | None]) -> list[Column]:
    """Which parts a posting belongs to, a boolean for each part that is not all."""
    return [F.coalesce(cond, F.lit(False)).alias(f"_in_{name}") for name, cond in parts.items() if cond is not None]


def _sums(parts: Mapping[str, Column | None], w: Column) -> list[Column]:
    return [F.sum(w if cond is None else F.when(F.col(f"_in_{name}"), w)).alias(name) for name, cond in parts.items()]


def _size(c: Column) -> Column:
    """``size(split(c, ";"))`` without the split."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(";"), F.lit(""))) + 1


def _of_days(df: DataFrame, singles: Mapping[tuple[str, str], Column], posted: str, inside: list[Column]) -> DataFrame:
    """(metric, key, w) rows of what a posting has once: added up per day, then
    laid out. Weights that are null or not above 0 do not count."""
    names = [f"_w{i}" for i in range(len(singles))]
    weights = [w.cast("long").alias(name) for name, w in zip(names, singles.values())]
    flat = df.select(F.to_date(posted).alias("_day"), *weights, *inside)
    daily = flat.groupBy("_day", *[c for c in flat.columns if c.startswith("_in_")]).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.when(F.col(name) > 0, F.col(name))).alias(name) for name in names])

    def row(metric: str, key: Column, w: str) -> Column:
        return F.struct(F.lit(metric).alias("metric"), key.alias("key"), F.col(w).alias("w"))

    rows = [row("day", F.date_format("_day", "yyyy-MM-dd"), "_n"),  # a posting without a date counts too
            *[row(metric, F.lit(key), name) for (metric, key), name in zip(singles, names)]]
    return daily.select(F.explode(F.array(*rows)).alias("r"), *_held(daily)).select("r.*", *_held(daily)).filter("w > 0")


def _held(df: DataFrame) -> list[str]:
    """The columns of ``_inside``."""
    return [c for c in df.columns if c.startswith("_in_")]


def _members(df: DataFrame, lists: Sequence[tuple[Column | str, Column]], inside: list[Column]) -> DataFrame:
    """(metric, key, w) rows of arrays of keys (null: none), one a member."""
    named = [F.struct((F.lit(m) if isinstance(m, str) else m).alias("metric"), keys.alias("keys")) for m, keys in lists]
    found = df.select(F.explode(F.array(*named)).alias("l"), *inside)
    found = found.select("l.metric", F.explode("l.keys").alias("key"), F.lit(1).cast("long").alias("w"), *_held(found))
    token = F.upper(F.trim("key"))
    key = F.when(F.col("metric") != "top_technology", F.col("key")).when(~token.isin("", "N/A"), token)
    return found.withColumn("key", key).filter("key is not null")


def facet_counts(df: DataFrame, flags: Sequence[str], as_of, posted: str = "date_posted", expiry: str = "expiration",
                 parts: Mapping[str, Column | None] = ALL) -> DataFrame:
    """(metric, key, a count for each part) of every counted facet: one expansion of each
    posting, one aggregate. A part without the key has null."""
    city = F.col("city").cast("string")
    cities = _replace_whole(city, {"Warsaw": "Warszawa"})
    aligned = (_size(cities) == _size(F.col("lat").cast("string"))) & (_size(cities) == _size(F.col("long").cast("string")))
    inside = _inside(parts)
    singles = {("kpi", "active_now"): F.when(F.to_date(expiry) > F.lit(str(as_of)).cast("date"), 1),
               ("city_share", "Others"): F.when(aligned, _size(cities)), **{("flag_total", f): F.col(f) for f in flags}}
    lists = [("top_employer", F.array(F.col("employer_name").cast("string"))), ("top_role", F.array(F.col("core_role").cast("string"))),
             ("region_count", F.split(F.upper("region"), ";")), ("top_technology", F.split("technologies_used", "[,;]")),
             # Both city metrics count the same member, unless the lists differ in length or the name is an alias.
             (F.when(aligned & (cities == city), F.lit("city")).otherwise(F.lit("top_city")), F.split(city, ";")),
             ("city_count", F.when(aligned & (cities != city), F.split(cities, ";")))]
    rows = _of_days(df, singles, posted, inside).unionByName(_members(df, lists, inside))
    counted = rows.groupBy("metric", "key").agg(*_sums(parts, F.col("w")))
    both = F.when(F.col("metric") == "city", F.array(F.lit("city_count"), F.lit("top_city"))).otherwise(F.array("metric"))
    return (counted.select(F.explode(both).alias("metric"), "key", *parts).groupBy("metric", "key")
            .agg(*[F.sum(name).alias(name) for name in parts]))


def _derived(counts: DataFrame, as_of, tops: Mapping[str, int], share: int) -> DataFrame:
    """(metric, key, value) parts, to be added up per key, from the counts."""
    limit = max([*tops.values(), share])
    # A full metric's ranked keys are limited too, so they pass a second time without a rank.
    twice = F.when(F.col("metric") == "city_count", F.array(F.lit("city_count"), F.lit("city_rank"))).otherwise(F.array("metric"))
    spread = counts.select(F.explode(twice).alias("metric"), "key", "n")
    ranked = F.col("metric").isin(*tops) | ((F.col("metric") == "city_rank") & (F.col("key") != "Others"))
    group = Window.partitionBy("metric", F.when(~ranked, F.xxhash64("key")), F.when(~ranked, F.col("key"))).orderBy(F.desc("n"), F.asc("key"))
    best = spread.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= limit)
    metric, key, n, rank = F.col("metric"), F.col("key"), F.col("n"), F.col("rank")

    def part(name: str, k: Column, value: Column = n) -> Column:
        return F.struct(F.lit(name).alias("metric"), k.cast("string").alias("key"), value.cast("double").alias("value"))

    day = F.to_date("key")
    of_day = F.array(part("kpi", F.lit("total")), part("kpi", F.when(day == F.date_sub(F.lit(str(as_of)).cast("date"), 1), F.lit("posted_yesterday"))),
                     part("daily_count", key), part("monthly_count", F.substring("key", 1, 7)),
                     part("weekday_count", F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(day) + 1)),
                     part("date_bound", F.when(day.isNotNull(), F.lit("min_date")), F.unix_date(day)),
                     part("date_bound", F.when(day.isNotNull(), F.lit("max_date")), F.unix_date(day)))
    of_rank = F.when((rank <= share) & (key != "Others"), F.array(part("city_share", key), part("city_share", F.lit("Others"), -n)))
    top = F.lit(False)
    for name, k in tops.items():
        top = top | ((metric == name) & (rank <= k))
    plain = metric.isin("kpi", "region_count", "city_count", "flag_total", "city_share") | top
    parts = F.when(metric == "day", of_day).when(metric == "city_rank", of_rank).when(plain, F.array(F.struct(metric, key, n.cast("double").alias("value"))))
    return best.select(F.explode_outer(parts).alias("p")).select("p.*").filter("key is not null")


def _fixed(spark, flags: Sequence[str]) -> DataFrame:
    """The members that a report always has: no value yet, or zero."""
    rows = [("weekday_count", d, None) for d in WEEKDAYS] + [("flag_total", f, 0.0) for f in flags]
    rows += [("kpi", k, 0.0) for k in ("posted_yesterday", "active_now", "total")] + [("city_share", "Others", 0.0)]
    return spark.createDataFrame(rows, "metric string, key string, value double")


def salary_counts(df: DataFrame, levels: Sequence[str], start: str = "start_salary", parts: Mapping[str, Column | None] = ALL) -> DataFrame:
    """(level, s, a count for each part): postings of each level and start salary."""
    level = F.explode(F.array(*[F.when(F.col(l) == 1, F.lit(l)) for l in levels])).alias("level")
    return (df.filter(F.col(start) != 0).select(level, F.col(start).cast("double").alias("s"), *_inside(parts)).filter("level is not null")
            .groupBy("level", "s").agg(*_sums(parts, F.lit(1).cast("long"))))


def salary_medians(counts: DataFrame, whisker: float = 10.0) -> DataFrame:
    """(metric, key, value): count and median start salary of each level from its
    (level, s, c) counts, amounts above Q3 + ``whisker`` times the interquartile range
    left out (A12)."""
    whole = Window.partitionBy("level")
    run = whole.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def quantile(q: float, n: Column, end: Column, c: Column) -> Column:
        at = (n - 1) * F.lit(q)

        def pick(rank):
            return F.max(F.when((rank < end) & (rank >= end - c), F.col("s"))).over(whole)

        low, high = pick(F.floor(at)), pick(F.ceil(at))
        return low + (at - F.floor(at)) * (high - low)

    n, end, c = F.col("n"), F.col("end"), F.col("c")
    ranked = counts.withColumn("end", F.sum("c").over(run)).withColumn("n", F.sum("c").over(whole))
    bounded = ranked.withColumn("q1", quantile(0.25, n, end, c)).withColumn("q3", quantile(0.75, n, end, c))
    kept = bounded.filter(F.col("s") <= F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).select("level", "s", "c", "end")
    kept = kept.withColumn("n", F.sum("c").over(whole))  # the largest amounts went, so the running counts stay
    out = kept.withColumn("median", quantile(0.5, n, end, c)).groupBy("level").agg(F.max("n").cast("double").alias("n"), F.max("median").alias("median"))
    parts = F.array(F.struct(F.lit("salary_count").alias("metric"), F.col("level").alias("key"), F.col("n").alias("value")),
                    F.struct(F.lit("salary_median").alias("metric"), F.col("level").alias("key"), F.round("median", 4).alias("value")))
    return out.select(F.inline(parts))


def daily_report(df: DataFrame, generation_id: str, as_of, flags: Sequence[str], levels: Sequence[str],
                 tops: Mapping[str, int] = TOPS, share: int = 9, counted: Sequence[DataFrame] | None = None, part: str = "n") -> DataFrame:
    """Every facet of one report as (generation_id, metric, key, value).
    ``counted``: the facet and salary counts of ``df`` where they are kept for several reports,
    of which ``part`` is reported."""
    facet, salary = counted or (facet_counts(df, flags, as_of), salary_counts(df, levels))
    found, paid = (c.filter(F.col(part) > 0) for c in (facet, salary))
    parts = _derived(found.select("metric", "key", F.col(part).alias("n")), as_of, tops, share).unionByName(_fixed(df.sparkSession, flags))
    value = (F.when((F.col("metric") == "date_bound") & (F.col("key") == "min_date"), F.min("value"))
             .when(F.col("metric") == "date_bound", F.max("value")).otherwise(F.sum("value")))
    rows = parts.groupBy("metric", "key").agg(value.alias("value")).unionByName(salary_medians(paid.select("level", "s", F.col(part).alias("c"))))
    return rows.select(F.lit(generation_id).alias("generation_id"), "metric", "key", "value")
