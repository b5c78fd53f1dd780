"""The training-data pipeline: language ID, exact deduplication, n-gram Jaccard
join, mixing to target weights, BPE encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes
it as Parquet and hands the table read back to the next stage. The first four
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm import bpe, exact_dedup, jaccard_join, langid, mixing
from hirelens.llm.common import column, free_names, read_table, release, save


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, as learned from ``lang`` of ``docs``: a
    text without a letter goes, and one that scores below the model's cut. Null
    texts go, rows that repeat are judged alike, no rows give none; without any
    labelled row every document goes."""
    return langid.keep(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id
    (a null id last). A null text equals an empty one; of rows alike one stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked ones: that with the component's id
    (of repeated ids, the first place; null ids last). Texts without words link with
    nothing and stay."""
    return jaccard_join.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets. A null
    source is a source; a text without words has size 0 and stays as often as its
    source's rate says; rows that repeat are drawn one by one."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32 bit) and the text
    decoded from them, for each copy. A null text has no tokens."""
    (key,) = free_names(docs, "key")
    keyed = docs.withColumn(key, F.struct(column(docs, "doc_id").alias("doc_id"), column(docs, "source").alias("source")))
    found = bpe.encode(keyed, key)
    return found.select("id.doc_id", "id.source", "n_tokens", "ids", "decoded")


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("mixing to target weights", mixed), ("BPE encoding", encoded)]

#: A learned classifier has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = given = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, sf_dir), "stage")
        if before is not given:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
