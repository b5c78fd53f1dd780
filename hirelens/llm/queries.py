"""The registered corpus queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann_blocks, bpe, exact_dedup, jaccard_join, langid, mixing, pii_crf, spelling, substring_dedup, term_scan, token_store,
               toxicity, warc)
from .common import crc_mod, read_columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op9_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (SELECT norm, count(*) AS group_size, max(len) AS len FROM n GROUP BY norm),
k AS (SELECT n.norm, min(doc_id) AS keep_id FROM n JOIN g ON n.norm = g.norm AND n.len = g.len GROUP BY n.norm)
SELECT n.doc_id, k.keep_id, g.group_size, n.doc_id = k.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm JOIN k ON n.norm = k.norm""")
def op9(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    return exact_dedup.assign(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op6_mix_sources", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::DOUBLE AS weight,
             3.0 * source_size::DOUBLE AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before,
             sum(weight) OVER () AS weight_all, sum(source_size) OVER () AS total
      FROM w WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - cap_before) / (weight_all - weight_before), cap / weight) FILTER
               (WHERE (total - cap_before) / (weight_all - weight_before) <= cap / weight) AS level FROM o),
t AS (SELECT source, source_size, least(weight * level, cap)::DOUBLE AS target FROM w, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix:' || key || ':' || (row_number() OVER (PARTITION BY key) - 1)::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM r""")
def op6(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mixing.plan(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                                    (F.col("size") * F.col("copies")).alias("taken"))


@query("op5_bpe_roundtrip")
def op5(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    return bpe.encode(docs).select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                   F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op10_nearest_vectors", """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op10(spark, sf_dir):
    vectors = read_columns(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return ann_blocks.nearest(vectors, F.col("vec_id") % 20 == 0)


@query("op7_substring_dedup")
def op7(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    return substring_dedup.remove_repeats(docs).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_jaccard_join")
def op3(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    return jaccard_join.assign(docs).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.train(docs.filter(~held))
    found = langid.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_columns(spark, sf_dir, "labels", ["doc_id", "toxic"])
    model = toxicity.train(docs, labels.filter(crc_mod(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_warc_transactions", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m""")
def op4(spark, sf_dir):
    pages = read_columns(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return warc.round_trip(pages).select("page_id", F.col("response.payload_bytes").alias("payload_bytes"),
                                         F.col("response.payload_digest").alias("payload_digest"), "record_type",
                                         F.col("refers_to.page_id").alias("refers_to"))


@query("op2_pii_spans")
def op2(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    found = pii_crf.find(docs, pii_crf.train(docs))
    base = F.filter("spans", lambda s: s.base)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    kinds = F.transform(base, lambda s: s.kind)
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii_crf.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op11_term_scan", r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
d AS (SELECT row_number() OVER () AS row, doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT i.item_id, d.doc_id, d.row,
             sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * d.n * s.docs) // s.words))))::BIGINT AS score
      FROM i JOIN tf ON i.term = tf.term JOIN w ON w.term = tf.term JOIN d ON d.row = tf.row, s GROUP BY i.item_id, d.doc_id, d.row),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""")
def op11(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    items = read_columns(spark, sf_dir, "benchmark", ["item_id", "text"])
    return term_scan.search(docs, items)


@query("op12_token_store")
def op12(spark, sf_dir):
    import public_tokenizers

    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    found = token_store.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    docs = read_columns(spark, sf_dir, "documents", ["doc_id", "text"])
    return spelling.variants(docs)
