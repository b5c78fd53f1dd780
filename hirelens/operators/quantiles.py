"""Exact quantiles of many groups without a buffer per group.

Two passes of counted ranges narrow to the wanted ranks. Equal values are counted
once (partial aggregation; all later steps read that one exchange). A sketch of
each group's distinct values gives cut points, values are counted per range between
them, and running counts over a group's few ranges tell which ranges hold the wanted
ranks. Only the values of those ranges are ranked one by one. Everything is lazy:
no job runs before the caller's action, and nothing is stored.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges a group is cut into; a range that holds a wanted rank is sorted in one task.
RANGES = 64


def exact_quantiles(df: DataFrame, group: str, value: str, qs: Sequence[float], prefix: str = "q",
                    weight: str | None = None, ranges: int = RANGES) -> DataFrame:
    """(group, n, <prefix>0, <prefix>1, ...): quantiles ``qs`` of the non-null
    ``value`` (a double) of each non-null ``group`` by linear interpolation between
    the two neighbouring ranks; ``n`` is the number of values.  A row counts
    ``weight`` times (a positive integer)."""
    one = F.lit(1) if weight is None else F.col(weight)
    counts = (df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
              .groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.sum(one).alias("_c")))
    cuts = counts.groupBy("_g").agg(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 4 * ranges).alias("_cuts"),
                                    F.sum("_c").alias("_n"))
    placed = _placed(counts.join(cuts, "_g"), ranges).drop("_cuts")
    parts = placed.groupBy("_g", "_p").agg(F.sum("_c").alias("_s"), F.max("_n").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    ranks = [(f"_{side}{i}", op((F.col("_n") - 1) * F.lit(float(q)))) for i, q in enumerate(qs) for side, op in (("lo", F.floor), ("hi", F.ceil))]
    held = F.lit(False)
    for _, rank in ranks:
        held = held | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_s")))
    wanted = parts.filter(held).select("_g", "_p", "_before")
    running = Window.partitionBy("_g", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(wanted, ["_g", "_p"]).withColumn("_end", F.col("_before") + F.sum("_c").over(running))
    picks = [F.max(F.when((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c")), F.col("_v"))).alias(name) for name, rank in ranks]
    found = ranked.groupBy("_g").agg(F.max("_n").alias("n"), *picks)
    out = []
    for i, q in enumerate(qs):
        at = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(F.floor(at) == F.ceil(at), low)
                   .otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(f"{prefix}{i}"))
    return found.select(F.col("_g").alias(group), "n", *out)


def _placed(df: DataFrame, ranges: int) -> DataFrame:
    """``df`` with ``_p``, the number of cut points ``_cuts`` (ascending, fewer than
    ``ranges``) below the value ``_v``: equal values share a range.  Found by halving."""
    out = df.withColumn("_p", F.lit(0))
    step = 1 << max(ranges - 1, 1).bit_length() - 1
    while step:
        out = out.withColumn("_p", F.col("_p") + F.when(F.get("_cuts", F.col("_p") + (step - 1)) < F.col("_v"), step).otherwise(0))
        step >>= 1
    return out
