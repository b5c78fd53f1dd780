"""op13: words, near words and roots against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from hirelens.llm import spelling
from hirelens.llm.common import read_table
from hirelens.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs, least_count=3):
    out = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= least_count}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, least_count=3):
    n = counted(docs, least_count)
    by = defaultdict(set)  # near words share a pattern with one code point left out or blanked
    for w in n:
        for i in range(len(w)):
            by[w[:i] + "\0" + w[i + 1 :]].add(w)
            by[w[:i] + w[i + 1 :]].add(w)
        by[w].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_apart(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "'w' as word", "3 as key", "'f' as form")


@pytest.mark.parametrize("letters,seed", [("abé", 1), ("ab", 2), ("aàáâãäåæçèéêëìíîïðñ", 3), ("abcdefghijkl", 4)])
def test_dense_words_against_brute_force(spark, letters, seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choices(letters, k=rnd.randint(4, 9))) for _ in range(60)]
    words = []
    for s in stems:
        for _ in range(12):
            w, i = s, rnd.randrange(len(s))
            kind = rnd.randrange(4)
            w = s if kind == 0 else s[:i] + s[i + 1 :] if kind == 1 else s[:i] + rnd.choice(letters) + s[i:] if kind == 2 else s[:i] + rnd.choice(letters) + s[i + 1 :]
            words += [w.upper() if rnd.random() < 0.2 and w.isascii() else w] * rnd.choice([1, 2, 3, 7, 20, 50])
    rnd.shuffle(words)
    docs = [(i, rnd.choice([" ", "-", "1", "\n"]).join(words[a : a + 37])) for i, a in enumerate(range(0, len(words), 37))]
    assert rows(spelling.variants(frame(spark, docs))) == brute(docs)


def test_long_chain_of_forms(spark):
    words = ["x" * k + "q" * 5 for k in range(14)]  # each next one a letter longer and twice as frequent
    docs = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(words[:9])]
    got = {r.word: r for r in spelling.variants(frame(spark, docs)).collect()}
    assert rows(spelling.variants(frame(spark, docs))) == brute(docs)
    assert got["qqqqq"].root == max(got, key=lambda w: got[w].n)


def test_ties_go_to_the_smaller_word(spark):
    docs = [(1000 + i, "zabcde zabcdf zabcdé abcd1 zabcd") for i in range(4)] + [(i + 1, "zabcdf zabcdé zabcde zabcdf zabcdé zabcde") for i in range(30)]
    assert rows(spelling.variants(frame(spark, docs))) == brute(docs)


def test_signatures_find_every_edit():
    rnd = random.Random(9)
    for _ in range(3000):
        w = "".join(rnd.choices("abcdeéÿ", k=rnd.randint(5, 12)))
        i = rnd.randrange(len(w))
        same, longer = w[:i] + rnd.choice("abcdeéÿ") + w[i + 1 :], w[:i] + rnd.choice("abcdeéÿ") + w[i:]
        keys = lambda x, role: {s[1:] for s in spelling.signatures(x) if s[0] == role}
        assert keys(w, "same") & keys(same, "same")
        assert keys(w, "short") & keys(longer, "long")


def test_odd_rows(spark):
    docs = [(None, "abcdef " * 3), (None, "abcdef"), (1, None), (2, ""), (3, "ab cd 12"), (4, "z" * 70_000 + " ") , (4, "z" * 70_000), (5, "z" * 70_000),
            (6, "×÷×÷×÷ ×÷×÷×÷ ×÷×÷×÷"), (7, "Ābcdefg 日本語 bcdefg bcdefg")]
    assert rows(spelling.variants(frame(spark, docs))) == brute(docs)


def test_no_documents(spark):
    assert rows(spelling.variants(frame(spark, []))) == []


def test_small_tables_of_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    docs = [(i, "one two three fouro fourth fifths sixths sevenths eights nineth") for i in range(20)]
    assert rows(spelling.variants(frame(spark, docs))) == brute(docs)


def test_registered_query_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert rows(QUERIES["op13_spelling_variants"](spark, sf)) == brute(docs)
