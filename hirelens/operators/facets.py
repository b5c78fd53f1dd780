"""Report aggregates.

All are grouped aggregates with partial (map-side) aggregation before the
shuffle; top-k uses ``orderBy(...).limit(k)`` which plans as
``TakeOrderedAndProject`` (per-partition top-k, then a k-row merge).  A
posting counts once everywhere except in the exploding facets (A4, A5, J3,
J11), which never rebind the base frame (fixes Q4/Q5).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mappings import WEEKDAYS
from .quantiles import exact_quantiles


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------- time series
def daily_counts(df: DataFrame, ts_col: str, out: str = "day") -> DataFrame:
    """A1: rows per calendar day, ordered by day."""
    return (df.groupBy(F.to_date(_c(ts_col)).alias(out)).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(out))


def monthly_counts(df: DataFrame, ts_col: str, out: str = "month") -> DataFrame:
    """A2: rows per month, key ``yyyy-MM``."""
    return (df.groupBy(F.date_format(_c(ts_col), "yyyy-MM").alias(out))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(out))


def weekday_counts(df: DataFrame, ts_col: str) -> DataFrame:
    """Rows per weekday, Monday..Sunday; days without rows are kept
    with a null count (as a reindex would).  The 7-row calendar is a fixed
    dimension, broadcast."""
    spark = df.sparkSession
    cal = spark.createDataFrame([(i, d) for i, d in enumerate(WEEKDAYS)], "weekday_idx int, weekday string")
    counts = (df.groupBy(F.weekday(_c(ts_col)).alias("weekday_idx"))
              .agg(F.count(F.lit(1)).alias("n")))
    return (F.broadcast(cal).join(counts, "weekday_idx", "left")
            .select("weekday_idx", "weekday", "n").orderBy("weekday_idx"))


# ------------------------------------------------------------ exploded facets
def exploded_counts(df: DataFrame, col: str, sep: str = ";", upper: bool = True,
                    out: str = "name") -> DataFrame:
    """A4: unnest a delimited column (optionally upper-cased) and count."""
    v = F.upper(_c(col)) if upper else _c(col)
    return (df.select(F.explode(F.split(v, sep)).alias(out))
            .groupBy(out).agg(F.count(F.lit(1)).alias("n")))


def with_share(counts: DataFrame, count_col: str = "n", out: str = "share") -> DataFrame:
    """Share of total per category.  The total is a scalar subquery
    (one global aggregate, evaluated once; no join, no window over one task)."""
    total = counts.agg(F.sum(count_col)).scalar()
    return counts.withColumn(out, F.when(total > 0, F.col(count_col) / total))


def dimension_counts(dim: DataFrame, counts: DataFrame, key: str = "name",
                     count_col: str = "n") -> DataFrame:
    """Every dimension member with its count, missing -> 0, ordered by
    count desc then key.  ``dim`` is a small bounded dimension."""
    return (dim.select(key).distinct().join(counts, key, "left")
            .fillna({count_col: 0}).orderBy(F.desc(count_col), key))


def aligned_locations(df: DataFrame, city: str = "city", lat: str = "lat", long: str = "long",
                      sep: str = ";", alias: dict | None = None) -> DataFrame:
    """J11 + F16: unnest parallel delimited lists together.  Rows whose list
    lengths differ are dropped, as in the source.  ``alias`` renames values
    (Warsaw -> Warszawa) before the unnest."""
    alias = alias if alias is not None else {"Warsaw": "Warszawa"}
    c = _c(city).cast("string")
    if alias:
        c = _replace_whole(c, alias)
    cs, la, lo = F.split(c, sep), F.split(_c(lat).cast("string"), sep), F.split(_c(long).cast("string"), sep)
    keep = (F.size(cs) == F.size(la)) & (F.size(cs) == F.size(lo))
    drop = {x.lower() for x in (city, lat, long) if isinstance(x, str)}
    rest = [c for c in df.columns if c.lower() not in drop]
    return (df.filter(keep)
            .select(*rest, F.inline(F.arrays_zip(cs.alias("c"), la.alias("la"), lo.alias("lo"))))
            .withColumnRenamed("c", "City").withColumnRenamed("la", "Latitude")
            .withColumnRenamed("lo", "Longitude"))


def _replace_whole(c: Column, mapping: dict) -> Column:
    """Whole-value replacement (pandas ``Series.replace`` semantics)."""
    out = c
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def city_counts(df: DataFrame, **kw) -> DataFrame:
    """A5: postings per city after the aligned unnest."""
    return (aligned_locations(df, **kw).groupBy("City")
            .agg(F.count(F.lit(1)).alias("Count")))


def minmax_scale(df: DataFrame, col: str, lo: float, hi: float, out: str = "Size") -> DataFrame:
    """Scale ``col`` to [lo, hi]; constant ``lo`` when the range is 0.
    min/max are scalar subqueries (global aggregates, no one-task window)."""
    mn, mx = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    rng = mx - mn
    return df.withColumn(out, F.when(rng > 0, F.lit(lo) + F.lit(hi - lo) * (F.col(col) - mn) / rng)
                         .otherwise(F.lit(float(lo))))


def city_bubbles(df: DataFrame, lo: float = 10.0, hi: float = 40.0, **kw) -> DataFrame:
    """J3 + W2: city counts joined with the distinct (city, lat, long)
    triples (a city with several pairs yields several rows), null
    coordinates dropped, bubble size scaled."""
    exploded = aligned_locations(df, **kw)
    counts = exploded.groupBy("City").agg(F.count(F.lit(1)).alias("Count"))
    coords = exploded.select("City", "Latitude", "Longitude").distinct()
    data = counts.join(coords, "City", "left").dropna(subset=["Latitude", "Longitude"])
    return minmax_scale(data, "Count", lo, hi)


def top_k_with_others(counts: DataFrame, key: str, count_col: str, k: int = 9,
                      other: str = "Others") -> DataFrame:
    """A9 + U1: the k largest rows plus one ``Others`` row with the sum of
    the rest (always present, possibly 0).  Ranking is a global order; the
    input is already one row per key (an aggregate), and the rank is taken
    with a k-row top list joined back, so no single-task window is needed.
    A null key is no value and is left out; a key that is itself ``other``
    always falls into the rest."""
    counts = counts.filter(F.col(key).isNotNull())
    top = counts.filter(F.col(key) != F.lit(other)).orderBy(F.desc(count_col), F.asc(key)).limit(k).select(key, F.lit(1).alias("_top"))
    tagged = counts.join(F.broadcast(top), key, "left")
    rest = (tagged.filter(F.col("_top").isNull())
            .agg(F.coalesce(F.sum(count_col), F.lit(0)).cast("bigint").alias(count_col))
            .select(F.lit(other).alias(key), count_col))
    kept = tagged.filter(F.col("_top").isNotNull()).select(key, F.col(count_col).cast("bigint"))
    return kept.unionByName(rest)


# --------------------------------------------------------------- flag totals
def flag_totals(df: DataFrame, flags: Sequence[str], name: str = "flag",
                value: str = "total") -> DataFrame:
    """Sum of each 0/1 flag column, reshaped wide -> long (one pass)."""
    wide = df.agg(*[F.sum(F.col(f)).cast("bigint").alias(f) for f in flags])
    return wide.unpivot([], list(flags), name, value)


# ------------------------------------------------------------------- top-k
def value_counts(df: DataFrame, col: str | Column, out: str = "value") -> DataFrame:
    """Rows per value; null is no value."""
    return df.filter(_c(col).isNotNull()).groupBy(_c(col).alias(out)).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, col: str | Column, k: int, out: str = "value") -> DataFrame:
    """K most frequent values; ties broken by value."""
    return value_counts(df, col, out).orderBy(F.desc("n"), F.asc(out)).limit(k)


def top_tokens(df: DataFrame, col: str, k: int, pattern: str = "[,;]",
               drop: Sequence[str] = ("", "N/A"), out: str = "technology") -> DataFrame:
    """Split on ``pattern``, trim, upper, drop blanks and ``N/A`` (Q13),
    then the k most frequent."""
    raw = df.select(F.explode(F.split(_c(col), pattern)).alias(out))
    toks = raw.select(F.upper(F.trim(out)).alias(out)).filter(~F.col(out).isin(*drop))
    return top_k(toks, out, k, out)


def top_exploded(df: DataFrame, col: str, k: int, sep: str = ";", out: str = "value") -> DataFrame:
    """K most frequent members of a delimited column (no alias rule)."""
    return top_k(df.select(F.explode(F.split(_c(col), sep)).alias(out)), out, k, out)


# ------------------------------------------------------------------- KPIs
def kpis(df: DataFrame, posted_col: str, expiry_col: str, as_of) -> DataFrame:
    """A10: posted yesterday, still active (expiry > as_of), total; one pass."""
    day = F.lit(str(as_of)).cast("date")
    return df.agg(
        F.count_if(F.to_date(posted_col) == F.date_sub(day, 1)).alias("posted_yesterday"),
        F.count_if(F.to_date(expiry_col) > day).alias("active_now"),
        F.count(F.lit(1)).alias("total"))


def date_bounds(df: DataFrame, col: str) -> DataFrame:
    """Min and max of a date column."""
    return df.agg(F.min(F.to_date(col)).alias("min_date"), F.max(F.to_date(col)).alias("max_date"))


# -------------------------------------------------------------- box statistics
def salary_box_stats(df: DataFrame, levels: Sequence[str], start: str = "start_salary",
                     high: str = "max_salary", whisker: float = 10.0) -> DataFrame:
    """Per level flag, rows with flag = 1 and start != 0; Q1/Q3 of the
    start salary by linear interpolation; keep start <= Q3 + whisker*IQR;
    then median, quartiles, mean and sample sd of start, max and mid salary.

    The levels are unpivoted into one ``level`` key so one grouped
    aggregate serves all of them; quantiles come from counted ranges, so no
    level is gathered in one buffer. Nothing runs before the caller's action.
    """
    stacked = (df.select(F.col(start).alias("s"), F.col(high).alias("m"),
                         F.explode(F.array(*[F.when(F.col(l) == 1, F.lit(l)) for l in levels])).alias("level"))
               .filter(F.col("level").isNotNull() & (F.col("s") != 0))
               # Equal salaries are one row with a count; every later step reads this exchange.
               .groupBy("level", "s", "m").agg(F.count(F.lit(1)).alias("c")))
    q = exact_quantiles(stacked, "level", "s", (0.25, 0.75), weight="c")
    bounds = q.select("level", F.col("q0").alias("_at"), (F.col("q1") + whisker * (F.col("q1") - F.col("q0"))).alias("_ub"))
    kept = (stacked.join(F.broadcast(bounds), "level")  # one row per listed level
            .filter(F.col("s") <= F.col("_ub"))
            .withColumn("mid", (F.col("s") + F.col("m")) / 2))
    names = (("start", "s"), ("max", "m"), ("mid", "mid"))
    c, at = F.col("c"), F.col("_at")
    # Moments of the distance from Q1, which keeps their differences exact.
    sums = [x for name, col in names for x in (
        F.sum(F.when(F.col(col).isNotNull(), c)).alias(f"_{name}_n"), F.sum(c * (F.col(col) - at)).alias(f"_{name}_1"),
        F.sum(c * (F.col(col) - at) * (F.col(col) - at)).alias(f"_{name}_2"))]
    # The three salaries as one column keyed (level, salary).
    long = kept.select("c", F.explode(F.array(*[F.struct(F.concat("level", F.lit("/" + name)).alias("k"), F.col(col).cast("double").alias("v"))
                                                for name, col in names])).alias("x")).select("c", "x.k", "x.v")
    quart = exact_quantiles(long, "k", "v", (0.25, 0.5, 0.75), weight="c")
    quart = quart.groupBy(F.substring_index("k", "/", 1).alias("level")).agg(*[
        F.max(F.when(F.substring_index("k", "/", -1) == name, F.col(f"q{i}"))).alias(f"{name}_{part}")
        for name, _ in names for i, part in enumerate(("q1", "median", "q3"))])
    out = kept.groupBy("level").agg(F.sum("c").alias("n"), F.max("_at").alias("_at"), *sums).join(quart, "level", "left")
    for name, _ in names:
        n, one, two = (F.col(f"_{name}_{x}") for x in ("n", "1", "2"))
        out = out.withColumn(f"{name}_mean", at + one / n).withColumn(
            f"{name}_sd", F.when(n > 1, F.sqrt(F.greatest((two - one * one / n) / (n - 1), F.lit(0.0)))))
    cols = ["level", "n"]
    for name, _ in names:
        cols += [f"{name}_q1", f"{name}_median", f"{name}_q3", f"{name}_mean", f"{name}_sd"]
    return out.select(*cols)


# ------------------------------------------------------------- report keys
def latest_other_key(df: DataFrame, key_col: str, key: str) -> DataFrame:
    """T4: the largest key other than ``key`` (the source's "closest")."""
    return df.filter(F.col(key_col) != F.lit(key)).select(key_col).orderBy(F.desc(key_col)).limit(1)


def nearest_other_date(df: DataFrame, key_col: str, key: str) -> DataFrame:
    """T4 variant: the date key nearest to ``key`` (ties -> later date)."""
    d = F.to_date(F.col(key_col))
    return (df.filter(F.col(key_col) != F.lit(key)).select(key_col)
            .orderBy(F.abs(F.datediff(d, F.lit(key).cast("date"))), F.desc(key_col)).limit(1))

