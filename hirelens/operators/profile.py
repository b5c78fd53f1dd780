"""Profiling (A13, A14, A21): describe, null profile, run report.

One aggregate over all columns, reshaped long with ``unpivot`` (no per-column
jobs, no driver loops); quartiles by ranks in range-partitioned order.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def describe(df: DataFrame, cols: Sequence[str], dates: Sequence[str] = ()) -> DataFrame:
    """Count (non-null), mean, sample sd, min, exact quartiles (linear
    interpolation), max per column, one row per column.  ``dates`` are
    described by their day number since 1970-01-01.  Columns are stacked into
    (column, value) so one grouped aggregate covers them all; the quartiles
    need no buffer per column (``quantiles``)."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]
    cells += [F.struct(F.lit(c).alias("column"), F.unix_date(F.to_date(c)).cast("double").alias("v")) for c in dates]
    stacked = df.select(F.explode(F.array(*cells)).alias("s")).select("s.column", "s.v")
    out = stacked.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(stacked, "column", "v", (0.25, 0.5, 0.75)).drop("n")
    return out.join(q, "column", "left").select("column", "count", "mean", "std", "min", F.col("q0").alias("q25"),
                                                F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count of every column (one aggregate), long form."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return (wide.unpivot([], cols, "column", "nulls")
            .withColumn("has_null", F.col("nulls") > 0))


def run_report(batch: DataFrame, key: str, after_dedup: DataFrame | None = None) -> DataFrame:
    """Batch size, distinct keys, emptiness (and size after dedup)."""
    cols = [F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(key)).alias("distinct_keys")]
    rep = batch.agg(*cols).withColumn("is_empty", F.col("rows") == 0)
    if after_dedup is not None:
        rep = rep.withColumn("rows_after_dedup", after_dedup.agg(F.count(F.lit(1))).scalar())
    return rep
