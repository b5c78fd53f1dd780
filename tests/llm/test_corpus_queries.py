"""Registered corpus queries: against their SQL where there is one, and the
pipeline's stages against what they promise."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from hirelens.llm import pii_crf
from hirelens.llm.common import read_table, save
from hirelens.llm.queries import ORACLE, QUERIES
from hirelens.sources.tables import TABLES

from . import test_jaccard_join, test_mixing, test_substring_dedup

SMALL = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


PER_DOCUMENT = sorted(n for n in QUERIES if n not in ORACLE and not n.startswith("op13_"))


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, name):
    docs = {r.doc_id for r in read_table(spark, SMALL, "documents").select("doc_id").collect()}
    got = [r.doc_id for r in QUERIES[name](spark, SMALL).select("doc_id").collect()]
    assert len(got) == len(docs) and set(got) == docs


def by_id(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SMALL).collect()}


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r.doc_id, r.text, r.source) for r in read_table(spark, SMALL, "documents").collect())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_registered_columns_against_the_library(spark, documents):
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in (words, pieces):
        t.no_truncation()
        t.no_padding()
    op5, op12, start = by_id(spark, "op5_bpe_roundtrip"), by_id(spark, "op12_token_store"), 0
    for key, text, _ in documents:
        ids = words.encode(text or "", add_special_tokens=False).ids
        r = op5[key]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(words.decode(ids, skip_special_tokens=False))
        ids = [*pieces.encode(text or "", add_special_tokens=False).ids, 0]
        r = op12[key]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_registered_columns_against_brute_force(spark, documents):
    texts = [t for _, t, _ in documents]
    op7, op3 = by_id(spark, "op7_substring_dedup"), by_id(spark, "op3_jaccard_join")
    for (key, _, _), (n, gone, kept) in zip(documents, test_substring_dedup.brute(texts, 35)):
        assert (op7[key].n_words, op7[key].n_removed, op7[key].kept_sha256) == (n, gone, sha(kept))
    for (key, _, _), want in zip(documents, test_jaccard_join.brute([k for k, _, _ in documents], texts)):
        assert (op3[key].n_shingles, op3[key].component_id) == want
    op2 = by_id(spark, "op2_pii_spans")
    for key, text, _ in documents:
        base = pii_crf.base_spans(text or "")
        listed = [f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in base]
        r = op2[key]
        assert r.base_sha256 == sha(",".join(listed)) and set(listed) <= set(r.spans.split(",")) | {""}
        assert [r[f"n_{kind}"] for kind in pii_crf.KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]


def test_registered_classifiers_hold_out_by_crc32(spark):
    docs = {r.doc_id: r for r in read_table(spark, SMALL, "documents").collect()}
    marks = {r.doc_id: r.toxic for r in read_table(spark, SMALL, "labels").collect()}
    op1, op8 = by_id(spark, "op1_language_id"), by_id(spark, "op8_toxicity")
    for key in docs:
        crc = zlib.crc32(str(key).encode())
        assert op1[key].held_out == (crc % 4 == 2) and op8[key].held_out == (crc % 5 == 0)
        assert 0 <= op1[key].score <= 1 and op8[key].predicted == int(op8[key].score >= 0.5)
    held = [k for k in docs if op1[k].held_out and docs[k].lang]
    assert sum(op1[k].lang_pred == docs[k].lang for k in held) >= 0.95 * len(held)
    assert sum(op8[k].predicted == marks[k] for k in docs if k in marks) >= 0.9 * sum(k in marks for k in docs)


def test_all_are_registered():
    names = entry.queries()
    assert set(QUERIES) <= set(names) and names["pipeline"] is corpus_pipeline.run
    assert [any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [True] * 13


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row int, __id int, __source int, __null int"


@pytest.fixture(scope="module")
def planted(spark):
    """Two sources, copies, near copies, junk and a text of no learned language."""
    rnd = random.Random(21)
    words = {"en": "the and of to that with this which have from house river stone".split(), "es": "el los las una para que con del por como casa agua sol".split()}
    rows = [(i, " ".join(rnd.choices(words[lang], k=rnd.randint(8, 60))), lang) for i in range(260) for lang in [("en", "es")[i % 2]]]
    for i in range(40):
        k, text, lang = rows[i]
        rows.append((1000 + i, text.replace(" ", "  ", 2) if i % 3 else text, lang))  # copies, some of them longer
    for i in range(40, 70):
        k, text, lang = rows[i]
        rows.append((2000 + i, text + " casa", lang))  # near copies where long enough
    rows += [(3000, "12 34", "en"), (3001, None, "es"), (3002, "", None), (3003, "Привет, как твои дела сегодня вечером, мой старый друг", None), (None, rows[3][1], "en")]
    rows = [(i, t, lang, ("a", "b", None)[k % 7 % 3], len(t or ""), 1, 2, 3, 4) for k, (i, t, lang) in enumerate(rows)]
    return save(spark.createDataFrame(rows, SCHEMA).repartition(5), "docs")


def all_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pipeline_stages_against_brute_force(spark, planted):
    stages = dict(corpus_pipeline.STAGES)
    given = all_rows(planted)
    docs = save(stages["language ID"](spark, planted, ""), "stage")
    kept = all_rows(docs)
    gone = [r for r in given if r not in kept]
    assert {r[0] for r in gone} == {3000, 3001, 3002, 3003} and docs.columns == planted.columns

    groups = {}
    for r in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    want = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    docs = save(stages["exact dedup"](spark, docs, ""), "stage")
    assert all_rows(docs) == sorted(want, key=str) and len(want) < len(kept)

    least = test_jaccard_join.brute([r[0] for r in want], [r[1] for r in want])
    want = [r for r, (_, c) in zip(want, least) if r[0] == c]
    before = docs.count()
    docs = save(stages["n-gram Jaccard join"](spark, docs, ""), "stage")
    assert all_rows(docs) == sorted(want, key=str) and len(want) < before

    size = {i: len((r[1] or "").split()) for i, r in enumerate(want)}
    total: dict = {}
    for i, r in enumerate(want):
        total[r[3]] = total.get(r[3], 0) + size[i]
    target, mixed = test_mixing.water(total), []
    for r in want:
        rate = target[r[3]] / total[r[3]]
        digest = hashlib.md5(f"mix:{'null' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}:0".encode()).hexdigest()
        mixed += [r] * (int(rate) + (int(digest[:13], 16) / 2**52 < rate - int(rate)))
    docs = save(stages["mixing to target weights"](spark, docs, ""), "stage")
    assert all_rows(docs) == sorted(mixed, key=str)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    encoded = []
    for r in mixed:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        encoded.append((r[0], r[3], len(ids), bytes(np.array(ids, "<u4").tobytes()), library.decode(ids, skip_special_tokens=False)))
    out = stages["BPE encoding"](spark, docs, "")
    assert sorted(str((r[0], r[1], r[2], bytes(r[3]), r[4])) for r in all_rows(out)) == sorted(map(str, encoded))


def test_the_pipeline_is_its_stages_in_a_row(spark):
    docs = read_table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, SMALL), "stage")
    assert all_rows(corpus_pipeline.run(spark, SMALL)) == all_rows(docs)


def test_language_stage_drops_texts_without_letters(spark):
    docs = save(spark.createDataFrame([(i, "the and of that with which", "en", "s", 1) for i in range(30)] + [(100, "12 34", "en", "s", 1), (101, None, "en", None, None)],
                                      "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == list(range(30))


def test_pipeline_of_no_documents(spark):
    docs = save(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    for _, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, ""), "stage")
    assert docs.count() == 0
