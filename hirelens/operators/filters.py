"""Facet filters (F1-F16) and the composite filter.

Each filter is a predicate on columns, so consecutive filters collapse into
one conjunctive ``Filter`` (CombineFilters) and push into the parquet scan
where they reference stored columns.  Long value lists become left-semi
joins instead of giant ``IN`` lists.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mappings import (LANGUAGE_FILTER_COLUMN, LEVEL_FILTER_COLUMN,
                        WORK_TYPE_FILTER_COLUMN)

def _or(preds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


def _and(preds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def date_range(df: DataFrame, col: str, start, end) -> DataFrame:
    """inclusive range; bounds swapped when reversed."""
    a, b = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    if str(start) > str(end):
        a, b = b, a
    return df.filter(F.to_date(F.col(col)).between(a, b))


def any_flag(columns: Sequence[str], flags: Sequence[str]) -> Column:
    """any chosen flag set; names absent from ``columns`` are ignored;
    no valid name -> no filtering."""
    valid = [f for f in flags if f in columns]
    if not valid:
        return F.lit(True)
    return _or([F.col(f) == 1 for f in valid])


def any_flag_filter(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.filter(any_flag(df.columns, flags))


def member_of(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """keep rows whose ``col`` is in ``values``: an ``IN`` list for a
    literal list (the caller holds it), a left-semi join for a DataFrame."""
    if isinstance(values, DataFrame):
        vals = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(vals, col, "left_semi")
    return df.filter(F.col(col).isin(list(values)))


def top_k_members(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """default when nothing is chosen: rows of the k most frequent
    values of ``col`` (ties by value; null is no value), via a k-row
    left-semi join."""
    top = (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), F.asc(col)).limit(k).select(col))
    return df.join(F.broadcast(top), col, "left_semi")


def level_filter(labels: str | Sequence[str]) -> Column:
    """level label(s) -> flag; several labels (``;``-joined or a list)
    are OR-ed (Q9).  Emoji or other prefixes before the label are ignored.
    Unknown labels filter nothing."""
    if isinstance(labels, str):
        labels = labels.split(";")
    cols = []
    for lab in labels:
        word = lab.strip().split()[-1] if lab.strip() else ""
        if word in LEVEL_FILTER_COLUMN:
            cols.append(LEVEL_FILTER_COLUMN[word])
    return _or([F.col(c) == 1 for c in cols]) if cols else F.lit(True)


def substring_any(col: str, values: str | Sequence[str]) -> Column:
    """case-sensitive substring any-of from a ``;`` list (trimmed)."""
    if isinstance(values, str):
        values = values.split(";")
    vals = [v.strip() for v in values]
    return F.coalesce(_or([F.col(col).contains(v) for v in vals]), F.lit(False))


def contains_any_ci(col: str, values: str | Sequence[str], regex: bool = False) -> Column:
    """case-insensitive any-of match, null -> false.  Literal by default
    (Q10); ``regex=True`` treats the values as one alternation pattern."""
    if isinstance(values, str):
        values = values.split(";")
    vals = [v.strip() for v in values]
    if regex:
        pred = F.col(col).rlike("(?iu)" + "|".join(vals))
    else:
        low = F.lower(F.col(col))
        pred = _or([low.contains(v.lower()) for v in vals])
    return F.coalesce(pred, F.lit(False))


def language_filter(columns: Sequence[str], language: str) -> Column:
    """F8: language name (first word, e.g. ``"Mandarin 🇨🇳"``) -> flag;
    ignored when the column is absent."""
    word = language.split()[0].lower() if language.split() else ""
    col = LANGUAGE_FILTER_COLUMN.get(word, f"language_{word}")
    return (F.col(col) == 1) if col in columns else F.lit(True)


def work_type_filter(columns: Sequence[str], work_types: str | Sequence[str]) -> Column:
    """OR of the chosen work-type flags (Q7)."""
    if isinstance(work_types, str):
        work_types = work_types.split(";")
    cols = [WORK_TYPE_FILTER_COLUMN[w.strip()] for w in work_types if w.strip() in WORK_TYPE_FILTER_COLUMN]
    cols = [c for c in cols if c in columns]
    return _or([F.col(c) == 1 for c in cols]) if cols else F.lit(False)


def open_filter(col: str, as_of: dt.date | str) -> Column:
    """still open: expiration >= as_of - 1 day."""
    return F.to_date(F.col(col)) >= F.date_sub(F.lit(str(as_of)).cast("date"), 1)


def facet_predicate(columns: Sequence[str], spec: Mapping[str, str], as_of,
                    regex: bool = False) -> Column:
    """AND of F5-F10 from a filter dict; absent keys are no-ops.
    ``company`` is an alias of ``employer_name`` (Q8)."""
    preds = []
    if spec.get("experience_level"):
        preds.append(level_filter(spec["experience_level"]))
    if spec.get("core_role"):
        preds.append(substring_any("core_role", spec["core_role"]))
    employer = spec.get("employer_name") or spec.get("company")
    if employer:
        preds.append(substring_any("employer_name", employer))
    if spec.get("city"):
        preds.append(contains_any_ci("city", spec["city"], regex))
    if spec.get("region"):
        preds.append(contains_any_ci("region", spec["region"], regex))
    if spec.get("language"):
        preds.append(language_filter(columns, spec["language"]))
    if spec.get("work_type"):
        preds.append(work_type_filter(columns, spec["work_type"]))
    if spec.get("expiration_date") == "current":
        preds.append(open_filter("expiration", as_of))
    return _and(preds)


def apply_filters(df: DataFrame, spec: Mapping[str, str], as_of, regex: bool = False) -> DataFrame:
    """F11 on a DataFrame; ``{}`` is the identity."""
    if not spec:
        return df
    return df.filter(facet_predicate(df.columns, spec, as_of, regex))


def drop_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F12."""
    return df.dropna(subset=list(cols))


def exclude_dates(df: DataFrame, col: str, dates: Sequence[str]) -> DataFrame:
    """drop rows of outlier load dates."""
    if not dates:
        return df
    return df.filter(~F.to_date(F.col(col)).isin([F.lit(d).cast("date") for d in dates]))


EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+"


def format_checks(date_col: str | None = None, time_col: str | None = None,
                  email_col: str | None = None) -> dict[str, Column]:
    """row-quality predicates: ISO date, ``HH:mm`` time and the e-mail
    prefix pattern ``[^@]+@[^@]+\\.[^@]+``."""
    out = {}
    if date_col:
        out["valid_date"] = F.coalesce(
            F.col(date_col).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") &
            F.try_to_timestamp(F.col(date_col), F.lit("yyyy-M-d")).isNotNull(), F.lit(False))
    if time_col:
        out["valid_time"] = F.coalesce(
            F.col(time_col).rlike(r"^\d{1,2}:\d{1,2}$") &
            F.try_to_timestamp(F.col(time_col), F.lit("H:m")).isNotNull(), F.lit(False))
    if email_col:
        out["valid_email"] = F.coalesce(F.col(email_col).rlike(EMAIL_PATTERN), F.lit(False))
    return out


def value_exists(requested: DataFrame, df: DataFrame, col: str, sep: str | None = ";",
                 out: str = "value") -> DataFrame:
    """which requested values occur in (the split members of) ``col``;
    a left-semi join against the distinct exploded dictionary."""
    members = df.select((F.explode(F.split(F.col(col), sep)) if sep else F.col(col)).alias(out)).distinct()
    req = requested.select(F.col(requested.columns[0]).alias(out))
    return req.join(members, out, "left_semi")


def same_length(a: str, b: str, sep: str = ";") -> Column:
    """F16: the two delimited lists have the same number of members."""
    return F.size(F.split(F.col(a), sep)) == F.size(F.split(F.col(b), sep))
