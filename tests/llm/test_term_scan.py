"""op11: ranked search by scanning against a brute-force ranking."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from hirelens.llm import term_scan

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best):
    found = [(key, Counter(terms(text))) for key, text in docs]
    found = [(k, c) for k, c in found if c]
    n, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for key, c in found:
            m = 100 - 50 + (50 * sum(c.values()) * n) // length
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, key is None, key, score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, key, score) for i, (_, _, key, score) in enumerate(scored[:best])]
    return out


def rows(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


def order(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2])))


def make(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "3 as row", "4 as term"),
            spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as id", "2 as terms", "3 as row"))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["alpha", "Beta", "x1", "été", "ÉTÉ", "naïve", "日本", "a", "ab", "abc", "b", "c-d", "😀x", "the"]
    docs = [(i, rnd.choice([" ", ", ", "\t"]).join(rnd.choices(vocab, weights=range(1, 15), k=rnd.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(80)]  # ties beyond the limit
    docs += [(2000, None), (2001, ""), (2002, "--- ..."), (2003, "abc " * 60_000), (None, docs[5][1]), (7, docs[5][1])]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(1, 8)))) for i in range(25)] + [(100, None), (101, "..."), (102, "nowhere"), (103, "the the THE")]
    d, it = make(spark, docs, items)
    want = brute(docs, items, 50)
    assert order(rows(term_scan.search(d, it))) == order(want)
    # many blocks of items, many small scans and tasks
    assert order(rows(term_scan.search(d.repartition(5), it, block=12))) == order(want)


def test_whole_terms_only(spark):
    docs = [(1, "abc"), (2, "ab c"), (3, "xabc abcx"), (4, "ABC"), (5, "abc-abc_abc.abc")]
    d, it = make(spark, docs, [(9, "abc")])
    assert rows(term_scan.search(d, it)) and order(rows(term_scan.search(d, it))) == order(brute(docs, [(9, "abc")], 50))
    assert {r[2] for r in rows(term_scan.search(d, it))} <= {1, 4, 5}


def test_small_pieces_and_grids_give_the_same(spark, monkeypatch):
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 30)))) for i in range(200)]
    items = [(i, " ".join(rnd.sample("abcdefgh", 3))) for i in range(6)]
    d, it = make(spark, docs, items)
    monkeypatch.setattr(term_scan, "PIECE", 300)
    monkeypatch.setattr(term_scan, "CELLS", 60)
    assert order(rows(term_scan.search(d, it, best=3))) == order(brute(docs, items, 3))


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "")])])
def test_nothing_to_find(spark, docs, items):
    d, it = make(spark, docs, items)
    assert rows(term_scan.search(d, it)) == []


def test_repeated_items_and_ids(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "c")]
    d, it = make(spark, docs, [(5, "a"), (5, "a"), (None, "c")])
    got = defaultdict(list)
    for item, rank, doc, _ in rows(term_scan.search(d, it)):
        got[item].append((rank, doc))
    assert sorted(got[5]) == [(1, 1), (1, 1), (2, 1), (2, 1)] and got[None] == [(1, 2)]
