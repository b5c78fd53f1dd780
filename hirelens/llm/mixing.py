"""Mixing sources to target weights.

Tokens are aggregated per source. Sources in code-point order (null last) weigh
``weights`` in turn and share the total; a target stops at ``cap`` times its
source's size and the excess is shared again by weight until none is above.
``rate = target / size`` is the repetition rate of the source: each document is
emitted floor(rate) times plus one copy with probability equal to the fraction, drawn
by a hash of seed, id, the text's digest and a number among rows that agree in both.
Reruns give the same copies.

A task never needs a whole source: sizes are partial sums, the source table
(one row per source) stays distributed and the driver sees one row of sums per
round of sharing. Documents find their source by a join that AQE may split, so a
source with a third of all rows is no bottleneck.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source of size 0 has target 0 and emits nothing; a null id draws
as the text ``null``; repeated rows draw each for itself, so a source of null ids or
of copies meets its target too (they are numbered per input partition, then the
partitions are added up, so no group of copies meets in one task); an empty table
gives none. ``df`` must be a stored table (or a deterministic read): where rows
repeat, they are numbered by place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, column, free_names, save


def draw(seed: str, key: Column, number: Column) -> Column:
    """Uniform in [0, 1) from 52 bits of md5(seed:key:number)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), number.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2 ** 52))


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """id and digest of the text: what tells rows apart in the draw."""
    return F.concat(F.coalesce(column(df, id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(column(df, text_col), F.lit(""))))


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, words, key and place of each document."""
    words = F.regexp_count(F.coalesce(column(df, text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    return df.select(column(df, id_col).alias("id"), column(df, source_col).alias("source"), words.alias("size"),
                     row_key(df, id_col, text_col).alias("key"), F.monotonically_increasing_id().alias("place"))


def numbers(measured: DataFrame) -> DataFrame | None:
    """(place, number) of the rows whose key repeats, numbered from 0 within a key;
    None if none does."""
    again = measured.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    if not again.limit(1).count():
        return None
    part = F.shiftright("place", 33).alias("part")  # the input partition
    rows = measured.select("key", "place", part).join(again, "key", "left_semi")
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("place")) - 1
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (rows.withColumn("within", within).join(parts.drop("n"), ["key", "part"])
            .select("place", (F.col("before") + F.col("within")).alias("number")))


def _copies(rate: Column, seed: str, key: Column, number: Column) -> Column:
    whole = F.floor(rate)
    return whole + (draw(seed, key, number) < rate - whole).cast("bigint")


def targets(measured: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size, target and rate of each source of ``measured``."""
    spark = measured.sparkSession
    per = measured.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    kind = T.StructType([*per.schema.fields, T.StructField("place", T.LongType())])
    placed = save(spark.createDataFrame(per.rdd.zipWithIndex().map(lambda p: (*p[0], p[1])), kind), "sources")
    turn = F.col("place") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    table = placed.select("source", "source_size", weight.alias("weight"),
                          (F.lit(float(cap)) * F.col("source_size")).alias("limit"))
    total, level, full = float(table.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        # Whoever is above the level's share stays at its limit; the rest share what is left.
        over = F.col("weight") * level > F.col("limit") if full >= 0 else F.lit(False)
        at_limit, free, n = table.agg(F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight"))),
                                      F.count(F.when(over, 1))).first()
        if n == full:
            break
        level, full = (total - (at_limit or 0.0)) / free if free else level, n
    target = F.least(F.col("weight") * level, F.col("limit"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return table.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies."""
    measured = save(sizes(df, id_col, text_col, source_col), "sizes")
    table = targets(measured, weights, cap)
    keyed = lambda d: d.withColumn("is_null", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    joined = keyed(measured).join(keyed(table), ["source", "is_null"])
    found = numbers(measured)
    joined = joined.withColumn("number", F.lit(0)) if found is None else joined.join(found, "place", "left").fillna({"number": 0})
    return joined.select("id", F.when(~F.col("is_null"), F.col("source")).alias("source"), "size", "source_size",
                         "target", "rate", _copies(F.col("rate"), seed, F.col("key"), F.col("number")).alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document of ``df`` as often as its plan says."""
    measured = save(sizes(df, id_col, text_col, source_col), "sizes")
    table, found = targets(measured, weights, cap), numbers(measured)
    of, null, rate, key, place, number, copy = free_names(df, "source_", "null_", "rate_", "key_", "place_", "number_", "copy_")
    table = table.select(F.coalesce("source", F.lit("")).alias(of), F.col("source").isNull().alias(null), F.col("rate").alias(rate))
    source = column(df, source_col)
    names = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    tagged = df.withColumns({of: F.coalesce(source, F.lit("")), null: source.isNull(), key: row_key(df, id_col, text_col), place: F.monotonically_increasing_id()})
    if found is None:
        tagged = tagged.withColumn(number, F.lit(0))
    else:
        tagged = tagged.join(found.select(F.col("place").alias(place), F.col("number").alias(number)), place, "left").fillna({number: 0})
    return (tagged.join(table, [of, null]).withColumn(copy, _copies(F.col(rate), seed, F.col(key), F.col(number))).filter(F.col(copy) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copy)))).select(*names))
