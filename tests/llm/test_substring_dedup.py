import collections
import random

import pytest

from hirelens.llm import substring_dedup
from hirelens.llm.common import save


def brute(texts, w):
    words = [(t or "").encode().split() for t in texts]
    count = collections.Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for x in words:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if count[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out.append((len(x), sum(gone), b" ".join(a for a, g in zip(x, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("window,hot,piece", [(35, 16, 8_000_000), (8, 2, 2_000), (12, 3, 500)])
def test_matches_brute_force(frame, monkeypatch, window, hot, piece):
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    monkeypatch.setattr(substring_dedup.window_rows, "__defaults__", (hot,))
    rnd = random.Random(window)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 4)))
    passages = [[word() for _ in range(rnd.randrange(5, 60))] for _ in range(6)]
    texts = []
    for i in range(150):
        out = [word() for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(out) + 1)
            out[at:at] = passages[min(rnd.randrange(9), 5)]
        texts.append(" ".join(out))
    texts += [None, "", " ", "a " * 300, "a b " * 50, texts[0], texts[0], "x y " * 200, "É é " * 40]
    rows = [(i if i % 7 else None, t, str(i)) for i, t in enumerate(texts)]
    df = save(frame(rows).repartition(4), "docs")
    got = {}
    for r in substring_dedup.remove_repeats(df.withColumnRenamed("doc_id", "old").withColumn("doc_id", df["source"].cast("long")), window=window).collect():
        got[r.id] = (r.n_words, r.n_removed, r.kept)
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_null_ids_and_empty(frame):
    df = save(frame([(None, "a b", "s"), (None, None, "s")]), "docs")
    assert sorted((r.id, r.n_words) for r in substring_dedup.remove_repeats(df).collect()) == [(None, 0), (None, 2)]
    assert substring_dedup.remove_repeats(frame([])).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_mix_up_are_told_apart(frame):
    # such twins agree in every polynomial modulo 2^64
    word = thue_morse(2048)
    twin = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(34))
    texts = [f"{rest} {word}", f"{rest} {twin}", f"{word} {word}"]
    df = save(frame([(i, t, "s") for i, t in enumerate(texts)]), "docs")
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect()}
    assert [got[i] for i in range(3)] == brute(texts, 35) and all(got[i][1] == 0 for i in range(3))


def test_very_long_texts(frame):
    rnd = random.Random(11)
    long = [str(rnd.randrange(10**6)) for _ in range(150_000)]
    texts = [" ".join(long), " ".join(long[70_000:70_050] + ["end"]), "y " * 90_000]
    df = save(frame([(i, t, "s") for i, t in enumerate(texts)]), "docs")
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df).collect()}
    assert [got[i] for i in range(3)] == brute(texts, 35)
