import random

import pyarrow as pa
import pytest

from hirelens.llm import jaccard_join as J
from hirelens.llm.common import save
from hirelens.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").translate(LOW).encode().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(ids, texts):
    s, lead = sets(texts), list(range(len(texts)))

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                lead[root(i)] = root(j)
    least = {}
    for i in range(len(s)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(len(x), least.get(root(i))) for i, x in enumerate(s)]


def corpus(seed, most):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(3))
    line = [word() for _ in range(12)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rnd.randrange(1, most))]
        for _ in range(rnd.randrange(1, 9)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 25 + 1)):
                copy[rnd.randrange(len(copy))] = word()
            if rnd.random() < 0.3:
                copy += line
            texts.append(" ".join(copy).title() if rnd.random() < 0.2 else " ".join(copy))
    return texts + [None, "", " \t", "a", "A", "a b", "a b c d e", "A b  c\nd e", "a b c d e f", "x " * 500, "x " * 400, "É b c d e", "é b c d e"]


@pytest.mark.parametrize("seed,most,cost,piece", [(1, 60, 4.0, 8_000_000), (2, 40, 0.01, 3_000), (3, 120, 1e6, 3_000)])
def test_components_match_brute_force(frame, monkeypatch, seed, most, cost, piece):
    monkeypatch.setattr(J, "PIECE", piece)
    texts = corpus(seed, most)
    ids = [i * 3 if i % 11 else None for i in range(len(texts))]
    df = save(frame([(i, t, str(k)) for k, (i, t) in enumerate(zip(ids, texts))]).repartition(3), "docs")
    docs = J.assign(df, scan_cost=cost).collect()
    place = {r["__place"]: int(r.source) for r in _placed(df)}
    got = {place[r.row]: (r.n, r.component_id) for r in docs}
    want = brute(ids, texts)
    assert [got[k][0] for k in range(len(texts))] == [n for n, _ in want]
    assert [got[k][1] for k in range(len(texts))] == [c if n else ids[k] for k, (n, c) in enumerate(want)]


def _placed(df):
    from pyspark.sql import functions as F
    return df.select("source", F.monotonically_increasing_id().alias("__place")).collect()


def test_dedup_keeps_one_row_of_each_component(frame):
    texts = corpus(7, 50)
    df = save(frame([(i, t, "s") for i, t in enumerate(texts)]), "docs")
    out = J.dedup(df)
    assert out.columns == df.columns
    want = brute(list(range(len(texts))), texts)
    assert sorted(r.doc_id for r in out.collect()) == [i for i, (n, c) in enumerate(want) if not n or c == i]


def test_empty(frame):
    assert J.assign(frame([])).count() == 0 and J.dedup(frame([])).count() == 0


def test_bit_maps_never_rule_out_a_link():
    import numpy as np
    rnd = np.random.default_rng(1)
    for _ in range(300):
        n = int(rnd.integers(2, 200))
        a = np.unique(rnd.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * rnd.uniform(0.6, 1))], rnd.integers(0, 2 ** 63, int(rnd.integers(0, 60))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert J._may_link([J.parity(a), J.parity(b)], np.array([len(a), len(b)]), np.array([0]), np.array([1]))[0]


def test_words_are_cut_at_ascii_space_only():
    got = J.Sets(1).of(pa.array(["a b c", None, "A b", "c"]))
    assert [len(x) for x in got] == [2, 0, 1, 1] and got[2][0] in got[0] and got[3][0] in got[0]


def test_boundary_follows_the_cost():
    sizes = {n: 10 for n in range(1, 257)}
    assert J.boundary(sizes, 0.01) < J.boundary(sizes, 4.0) < J.boundary(sizes, 1e6)


@pytest.mark.parametrize("n", [1, 2, 37])
def test_components_of_paths_and_rings(spark, n):
    rnd = random.Random(n)
    names = rnd.sample(range(-1000, 1000), n + 2)
    edges = [(names[i], names[i + 1]) for i in range(n)] + [(names[0], names[0])]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(names[: n + 1]) for x in names[: n + 1]}


def template_pages(n):
    """Pages of one template with 76 of 96 shingles shared, which do not link; every
    hundredth has a copy with another last word, which does."""
    shared = " ".join(f"t{i}" for i in range(80))
    pages = [shared + " " + " ".join(f"p{k}x{i}" for i in range(20)) for k in range(n)]
    return pages + [pages[k].rsplit(" ", 1)[0] + " last" for k in range(0, n, 100)]


def test_pages_of_one_template_are_settled_in_bounded_groups(frame, monkeypatch, tmp_path):
    n, settle, folder = 4000, J._open_pairs, str(tmp_path)

    def watched(batches):
        def see():
            classes = {}
            for batch in batches:
                for p, s, x in zip(*(batch.column(c).to_pylist() for c in ("pivot", "salt", "sid"))):
                    classes.setdefault((p, s), set()).add(x)
                yield batch
            if classes:
                import uuid
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(max(map(len, classes.values()))))
        yield from settle(see())

    monkeypatch.setattr(J, "_open_pairs", watched)
    df = save(frame([(i, t, "s") for i, t in enumerate(template_pages(n))]).repartition(8), "docs")
    got = {r.id: r.component_id for r in J.assign(df).collect()}
    assert got == {i: i if i < n else (i - n) * 100 for i in range(n + n // 100)}
    most = max(int(f.read_text()) for f in tmp_path.iterdir())
    assert 1000 < most <= 2500


def test_blocks_of_long_lists_match_brute_force(frame, monkeypatch):
    monkeypatch.setattr(J, "LONG", 5)
    monkeypatch.setattr(J, "BLOCK", 4)
    texts = template_pages(120) + corpus(11, 60)
    df = save(frame([(i, t, "s") for i, t in enumerate(texts)]).repartition(3), "docs")
    want = brute(list(range(len(texts))), texts)
    assert {r.id: r.component_id for r in J.assign(df).collect()} == {i: c if n else i for i, (n, c) in enumerate(want)}


def test_words_that_polynomials_mix_up_are_told_apart(frame):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word.upper(), "x " * 30 + word]
    df = save(frame([(i, t, "s") for i, t in enumerate(texts)]), "docs")
    got = {r.id: (r.n, r.component_id) for r in J.assign(df).collect()}
    assert [got[i] for i in range(4)] == brute(range(4), texts) and got[1][1] == 1


def test_sets_with_half_a_hash_in_common_stay_apart(frame, monkeypatch):
    whole = J.sid

    def half(s):  # every set of one shingle falls on one class name
        return (7, whole(s)[1]) if len(s) == 1 else whole(s)

    monkeypatch.setattr(J, "sid", half)
    texts = ["a b c d e", "f g h i j", "a b c d e", "k l", None, "a b c d e f g"]
    df = save(frame([(i, t, "s") for i, t in enumerate(texts)]), "docs")
    got = {r.id: (r.n, r.component_id) for r in J.assign(df).collect()}
    assert [got[i] for i in range(6)] == brute(range(6), texts)


def test_very_long_texts(frame):
    rnd = random.Random(12)
    base = [str(rnd.randrange(10**6)) for _ in range(120_000)]
    near = list(base)
    for i in range(0, 120_000, 500):
        near[i] = "other"
    texts = [" ".join(base), " ".join(near), " ".join(base[:60_000]), "z " * 100_000]
    df = save(frame([(i, t, "s") for i, t in enumerate(texts)]), "docs")
    got = {r.id: (r.n, r.component_id) for r in J.assign(df).collect()}
    assert [got[i] for i in range(4)] == brute(range(4), texts) and got[1][1] == 0


def test_dedup_keeps_columns_of_any_name(spark):
    df = save(spark.createDataFrame([(i, "a b c d e f g" if i < 3 else f"t{i}", 5, "r") for i in range(6)], "doc_id long, text string, row long, `ROW_` string"), "docs")
    out = J.dedup(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == [(i, "a b c d e f g" if i < 3 else f"t{i}", 5, "r") for i in (0, 3, 4, 5)]
