"""op12: the pieces against the library, the block codec, files written and read."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hirelens.llm import piece_encoder, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return piece_encoder.Encoder(PATH)


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


def test_every_plain_character_as_the_library(encoder, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not piece_encoder._STRANGE.match(chr(c))]
    assert len(points) > 20_000
    texts = [f"a{chr(c)}b1{chr(c)}{chr(c)} {chr(c)}'{chr(c)}" for c in points]
    assert split(*encoder(texts)) == library(texts)


def test_random_texts_as_the_library(encoder, library):
    rnd = random.Random(3)
    some = [*"ab1 '  \n\t!-stmdrvel'é", "'s", "'re", "'ll", " '", "<|endoftext|>", "日本", "😀", " ", "͸", "word", " the"]
    texts = ["".join(rnd.choices(some, k=rnd.randint(0, 16))) for _ in range(20_000)] + ["", " ", "\n\n", "x" * 50_000, " ab" * 30_000]
    assert split(*encoder(texts)) == library(texts)


def test_forgetting_pieces_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_encoder, "REMEMBERED", 40)
    small = piece_encoder.Encoder(PATH)
    texts = [f"word{i} and word{i % 7}, more" for i in range(400)]
    for a in range(0, 400, 9):
        assert split(*small(texts[a : a + 9])) == library(texts[a : a + 9])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=token_store.BLOCK))
def test_blocks_round_trip(numbers):
    row = np.array(numbers, dtype=np.uint32)
    data = b"xx" + token_store.pack(row) + b"tail"
    assert token_store.unpack(memoryview(data), 2).tolist() == numbers


def test_blocks_are_small_and_patched():
    row = np.arange(4096, dtype=np.uint32) % 64 + 70_000
    assert len(token_store.pack(row)) < 4096 * 6 // 8 + 20
    row[::100] = 2**32 - 1  # outliers go to the exception list, the width stays
    assert len(token_store.pack(row)) < 4096 * 6 // 8 + 20 + 41 * 6 + 1
    assert len(token_store.pack(np.full(4096, 9, np.uint32))) < 20
    broken = bytearray(token_store.pack(row))
    broken[40] ^= 1
    with pytest.raises(ValueError):
        token_store.unpack(memoryview(bytes(broken)), 0)


def test_any_range_of_a_file():
    rnd = np.random.default_rng(1)
    w = token_store.Writer(3)
    counts = rnd.integers(1, 900, 60)
    ids = rnd.integers(0, 50_257, counts.sum()).astype(np.uint32)
    data = b"".join(r + b"\n" for r in [*w.add(ids, counts, np.arange(60), np.zeros(60, np.uint32)), *w.close()])
    for a, b in [(0, 0), (0, 1), (4095, 4097), (100, len(ids)), (0, len(ids)), (8192, 8192 + 4096)]:
        assert token_store.ids_between(data, a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(Exception):
        token_store.Reader(memoryview(data[:-5]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "3 as place", "4 as file", "5 as mark")


def want(rows, library):
    texts = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    start, out = 0, []
    for (key, _), ids in zip(texts, library([t for _, t in texts])):
        ids = [*ids, 0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [100, 5000, 1 << 26])
def test_files_round_trip(spark, library, file_bytes):
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choices(["one", "Two", "3", "été", "\n", "日本"], k=rnd.randint(0, 60)))) for k in rnd.sample(range(-500, 10**12), 200)]
    rows += [(None, "only null"), (10**15, None), (10**15 + 1, ""), (10**15 + 2, "long " * 40_000)]
    got = token_store.round_trip(frame(spark, rows).repartition(4), PATH, file_bytes=file_bytes, with_ids=True).collect()
    assert sorted(((r.id, r.start, r.n, r.crc32) for r in got), key=lambda r: r[1]) == want(rows, library)
    assert all(zlib.crc32(r.ids) == r.crc32 and len(r.ids) == 4 * r.n for r in got)


def test_equal_ids_and_repeated_rows(spark, library):
    rows = [(5, "b b"), (5, "a"), (5, "a"), (None, "x y z"), (None, None), (4, "q")]
    got = sorted((r.start, r.n, r.id) for r in token_store.round_trip(frame(spark, rows), PATH, file_bytes=3).collect())
    assert [r[0] for r in got] == [sum(x[1] for x in got[:i]) for i in range(len(got))]
    assert [r[2] for r in got] == [None, None, 4, 5, 5, 5]
    again = sorted((r.start, r.n, r.id) for r in token_store.round_trip(frame(spark, rows), PATH, file_bytes=3).collect())
    assert got == again


def test_no_documents(spark):
    assert token_store.round_trip(frame(spark, []), PATH).collect() == []
