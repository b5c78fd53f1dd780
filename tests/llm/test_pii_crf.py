import random
import re

import numpy as np
import pytest

from hirelens.llm import pii_crf

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii_crf.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(0)
    for _ in range(6000):
        text = "".join(rnd.choice("a.b@c-1234567890+ ()_%é.@1 ") for _ in range(rnd.randrange(60)))
        assert pii_crf.base_spans(text) == brute(text), text
    for _ in range(3000):
        text = "".join(rnd.choice("1234567890" * 3 + ".+ -") for _ in range(rnd.randrange(80)))
        assert pii_crf.base_spans(text) == brute(text), text


def test_luhn():
    assert pii_crf.luhn("79927398713") and not pii_crf.luhn("79927398710")


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 50_000, "1." * 100_000, "+1 " * 60_000, "+1" + " " * 200_000, "1 " * 100_000):
        pii_crf.base_spans(text)


def number(rnd):
    return f"+1 ({rnd.integers(200, 999)}) 555-{rnd.integers(1000, 9999)}"


@pytest.fixture(scope="module")
def model(spark):
    rnd = np.random.default_rng(4)
    words = "alpha beta gamma delta room page 12 2024 99 item".split()
    rows = []
    for i in range(400):
        text = list(rnd.choice(words, 30))
        for at in rnd.integers(0, 30, 2):
            text[at] = [number(rnd), f"joe.{i}@site{i}.org", f"10.{i % 250}.3.4", "4111111111111111"][int(rnd.integers(4))]
        rows.append((i, " ".join(text)))
    return pii_crf.train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_repeated_mentions_are_added_and_others_left_alone(spark, model):
    a = "call +1 (741) 555-3069 now, or 741-555-3069 then; room 2024 page 12 item 7415553070"
    b = "room 2024 page 12 item 7415553069"
    rows = [(1, a), (2, b), (3, None), (4, ""), (None, a), (1, a), (5, "no digit"), (6, "x@y.org " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as spans")
    got = pii_crf.find(df, model).collect()
    assert len(got) == len(rows)
    by = {r.id: r.spans for r in got}
    base = [(s.kind, s.text) for s in by[1] if s.base]
    added = [(s.kind, s.text) for s in by[1] if not s.base]
    assert base == [("phone", "+1 (741) 555-3069")] and added == [("phone", "741-555-3069")]
    assert by[None] == by[1] and by[2] == by[3] == by[4] == by[5] == [] and len(by[6]) == 3000
    assert all(a[s.start : s.end] == s.text for s in by[1])


def test_propagation_is_exact_on_a_tree():
    rnd = np.random.default_rng(1)
    model = pii_crf.Model(rnd.normal(size=(pii_crf.DIM, 5)), np.eye(5) * 0.7, np.eye(5) * 1.3)
    edges, skip = np.array([[0, 1], [1, 2], [1, 3]]), np.array([False, True, False])
    g = pii_crf.Graph(np.arange(4), np.arange(4) + 1, rnd.integers(0, pii_crf.DIM, (4, pii_crf.WIDTH)), np.array([0, 0, 3, 0]), edges, skip)
    unary = model.node[g.features].sum(axis=1)
    want = np.zeros((4, 5))
    for y in np.ndindex(5, 5, 5, 5):
        if y[2] == 3:
            p = np.exp(sum(unary[i, y[i]] for i in (0, 1, 3)) + sum((model.skip if s else model.chain)[y[a], y[b]] for (a, b), s in zip(edges, skip)))
            for i in range(4):
                want[i, y[i]] += p
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(pii_crf.marginals(g, model, rounds=60), want, atol=1e-6)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "plain text")], "doc_id long, text string")
    model = pii_crf.train(df)
    assert pii_crf.find(df, model).collect()[0].spans == [] and pii_crf.find(df.limit(0), model).count() == 0


@pytest.mark.parametrize("text,want", [
    ("card 4111 1111 1111 1111 page alpha 4111.1111.1111.1111 beta", [("card", "4111.1111.1111.1111")]),
    ("card 4111.1111.1111.1111 page 12 item +44 20 7946 0958 beta, gamma 020 7946 0958 delta 02079460958 end", [("phone", "020 7946 0958"), ("phone", "02079460958")]),
    ("call +44 20 7946 0958 alpha 2024 7946 1234 beta", [])])
def test_numbers_in_blanks(model, text, want):
    added = pii_crf.added_spans(text, pii_crf.base_spans(text), model, 0.6)
    assert [(pii_crf.KINDS[k], text[a:b]) for a, k, b in added] == want


def test_a_local_part_of_letters_is_tied_to_its_address():
    text = "mail johnsmith@x.org alpha room johnsmith beta"
    g = pii_crf.graph(text, pii_crf.base_spans(text))
    assert [text[a:b] for a, b in zip(g.start, g.end)] == ["johnsmith@x.org", "johnsmith"]
    assert g.edges.tolist() == [[0, 1]] and g.skip.all()
