"""Exact deduplication with skew-safe combining (DataFrame functions only).

Texts are equal when they agree after every character of ``[\\x20\\x09-\\x0D]``
is deleted. Copies meet in three steps, each grouped by the digest *and* the
whole normalised text, so a digest collision can never merge two texts:

1. local: the map-side half of the first aggregation keeps one row per text and
   input partition;
2. salted: these rows meet by (digest, salt), the salt being drawn from the
   input partition, so a text that holds a third of all rows is spread over
   ``salts`` groups;
3. global: at most ``salts`` winners per text meet and give the final one.

The winner is the row with the most code points in the original text, then the
smallest id. Both are packed into one decimal, which hash aggregation updates in
place; a struct would force a sort of the texts.

Defined cases: a null text is empty; all empty texts form one group; a null id
loses every tie; of rows that repeat id, text and length exactly one is kept;
extra columns are never read by ``assign`` and pass through ``dedup`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, column, free_names

#: Base of the packed (length, id) order; ids are shifted to 1 .. 2^64.
_BASE = "36893488147419103232"
_TOP = "9223372036854775808"


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _packed(length: Column, key: Column) -> Column:
    shifted = F.lit(_TOP).cast("decimal(20,0)") - key.cast("decimal(20,0)")
    return (length.cast("decimal(11,0)") * F.lit(_BASE).cast("decimal(20,0)")
            + F.coalesce(shifted, F.lit(0).cast("decimal(21,0)"))).cast("decimal(38,0)")


def _unpacked_id(best: Column) -> Column:
    low = best % F.lit(_BASE).cast("decimal(20,0)")
    return F.when(low > 0, (F.lit(_TOP).cast("decimal(20,0)") - low).cast("bigint"))


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """id, digest, a second check sum, length and the normalised text of each row."""
    text = column(df, text_col)
    base = df.select(column(df, id_col).cast("bigint").alias("id"), normalise(text).alias("norm"),
                     F.coalesce(F.length(text), F.lit(0)).alias("length"))
    return base.select("id", "length", "norm", digest(F.col("norm")).alias("digest"),
                       F.unhex(F.md5("norm")).alias("check"))


def winners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
            digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text: digest, check, best (packed order), n (rows)."""
    rows = _rows(df, id_col, text_col, digest).select(
        "digest", "check", "norm", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        _packed(F.col("length"), F.col("id")).alias("best"))
    salted = rows.groupBy("digest", "check", "salt", "norm").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    merged = salted.groupBy("digest", "check", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    # Rows find their group by (digest, check) without carrying the text; should two
    # texts ever share both, stop instead of mixing them.
    found = merged.groupBy("digest", "check").agg(F.max("best").alias("best"), F.sum("n").alias("n"),
                                                  F.count("*").alias("texts"))
    clash = F.raise_error(F.lit("two texts share both check sums")).cast("bigint")
    return found.select("digest", "check", "best", F.when(F.col("texts") > 1, clash).otherwise(F.col("n")).alias("n"))


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
           digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, length."""
    best = winners(df, id_col, text_col, salts, digest)
    rows = _rows(df, id_col, text_col, digest).select(
        "id", "digest", "check", "length", F.sha2("norm", 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("home"))
    # The third key makes both sides plain shuffles, so AQE may split a hot text's rows.
    part = (F.crc32("digest") % 64).alias("part")
    joined = rows.select("*", part).join(best.select("*", part), ["digest", "check", "part"])
    # Of rows that repeat id and text one stays: first per input partition, then one of
    # those; a row that has lost is a group of its own, so no group grows with its copies.
    first = F.row_number().over(Window.partitionBy("id", "text_sha256", "home").orderBy(F.col("length").desc()))
    joined = joined.withColumn("lost", F.when(first > 1, F.col("place")))
    turn = F.row_number().over(Window.partitionBy("id", "text_sha256", "lost").orderBy(F.col("length").desc()))
    keep = _unpacked_id(F.col("best"))
    return joined.select("id", keep.alias("keep_id"), F.col("n").alias("group_size"),
                         ((turn == 1) & F.col("lost").isNull() & F.col("id").eqNullSafe(keep)).alias("kept"), "text_sha256", "length")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    key, sha, size, null = free_names(df, "key_", "sha_", "size_", "null_")
    keep = (assign(df, id_col, text_col, salts).filter("kept")
            .select(F.col("id").alias(key), F.col("text_sha256").alias(sha), F.col("length").alias(size)))
    text = column(df, text_col)
    tagged = df.select("*", column(df, id_col).cast("bigint").alias(key), F.sha2(normalise(text), 256).alias(sha),
                       F.coalesce(F.length(text), F.lit(0)).alias(size))
    # A null id must match itself; a flag and a filler keep this an equi-join.
    filled = lambda d: d.withColumn(null, F.col(key).isNull()).withColumn(key, F.coalesce(key, F.lit(0)))
    on = [key, null, sha, size]
    return filled(tagged).join(filled(keep), on, "left_semi").dropDuplicates(on).select(
        *["`" + c.replace("`", "``") + "`" for c in df.columns])
