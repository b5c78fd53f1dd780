"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, save


def _least(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with the least ``value`` of all rows of its ``u``. The second join
    key makes both sides plain shuffles, which AQE may split where a node is hot."""
    least = df.groupBy("u").agg(F.min(value).alias(name)).withColumn("u2", F.col("u") % 64)
    return df.withColumn("u2", F.col("u") % 64).join(least, ["u", "u2"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, not null) -> node, component (the least node of its
    component), a written table of one row for each node that has an edge to another
    node. Every round is written to the shared checkpoint folder and deleted when
    the next is; the driver sees one check sum."""
    e = save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_least(both, "m", F.least("u", "v")).filter("v > u")
                 .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").distinct())
        small = _least(large, "m", F.col("v"))
        last = e
        e = save(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                 .select("x.u", "x.v").filter("u <> v").distinct(), "edges")
        release(last)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = save(nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    release(e)
    return out
