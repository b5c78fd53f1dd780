import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hirelens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "Σας ΟΔΥΣΣΕΥΣ İstanbul ﬁ Å é", "<|startoftext|>Hi<|endoftext|> there <|endoftext|", "it's we'll I'd x'REally 12 345 ½ Ⅷ ²",
       "a\x1cb\x1d\x85c d​e﻿", "x" * 1000, "ab" * 30_000, "日本語テキスト 🙂🙂👍🏽", "the " * 5000, "hello--world!!! ..a.b"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéèüñß'.,! \n"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(400))) for _ in range(150)]


def test_matches_the_library_and_decodes(library):
    some = texts()
    own = bpe.WordBpe(PATH)
    ids = own.encode(some)
    for text, got, back in zip(some, ids, own.decode(ids)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want
        assert back == library.decode(want, skip_special_tokens=False)


def test_long_and_packed_words_agree():
    own, rnd = bpe.WordBpe(PATH), random.Random(5)
    words = ["".join(rnd.choice("abehinorst") for _ in range(n)) for n in range(2, 65)]
    packed = own.merge(words)
    flat, ends = own._symbols(words)
    for word, a, b in zip(words, [0, *ends[:-1]], ends):
        assert own._merge_long(flat[a:b]) == packed[word]


def test_a_full_table_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "HELD", 5)
    own = bpe.WordBpe(PATH)
    for text in texts()[:30]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_frame(frame, library):
    rows = [(1, None, "s"), (None, "hello world", "s"), (2, "hello world", "s"), (2, "hello world", "s"), (3, "", "s")]
    got = bpe.encode(frame(rows)).collect()
    want = library.encode("hello world").ids
    assert sorted((r.id is None, r.id or 0, r.n_tokens) for r in got) == [(False, 1, 0), (False, 2, 2), (False, 2, 2), (False, 3, 0), (True, 0, 2)]
    assert all(np.frombuffer(r.ids, "<u4").tolist() == (want if r.n_tokens else []) for r in got)
    assert bpe.encode(frame([])).count() == 0
