import pytest

from hirelens.llm import mixing
from hirelens.llm.common import save


def water(sizes, cap=3.0):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        level = (total - sum(cap * sizes[s] for s in capped)) / free if free else 0.0
        more = {s for s in names if s not in capped and weight[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= more


ROWS = ([(i, "w " * (i % 7 + 1), "b") for i in range(200)] + [(1000 + i, "x y", "a") for i in range(5)]
        + [(2000 + i, "one", None) for i in range(3)] + [(3000, None, "empty"), (3001, " ", "empty"), (None, "q q", "c"), (4000, "v", "é")])


def test_targets_copies_and_reruns(frame):
    df = frame(ROWS)
    sizes: dict = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    got = mixing.plan(df).collect()
    assert len(got) == len(ROWS)
    taken: dict = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-12) and r.source_size == sizes[r.source]
        assert int(r.rate) <= r.copies <= int(r.rate) + 1 and r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    assert taken["b"] == pytest.approx(want["b"], rel=0.15)
    assert taken["a"] == want["a"] == 30  # three times its size
    again = mixing.plan(df.repartition(7))
    plain = lambda rs: sorted(str((r.id, r.source, r.size, r.copies)) for r in rs)
    assert plain(again.collect()) == plain(got)


def test_mix_emits_the_planned_copies(frame):
    df = frame(ROWS)
    plan = {(r.id, r.source): r.copies for r in mixing.plan(df).collect()}
    out = mixing.mix(df)
    assert out.columns == df.columns
    seen: dict = {}
    for r in out.collect():
        seen[r.doc_id, r.source] = seen.get((r.doc_id, r.source), 0) + 1
    assert seen == {k: v for k, v in plan.items() if v}


def test_empty_and_single_source(frame):
    assert mixing.plan(frame([])).count() == 0 and mixing.mix(frame([])).count() == 0
    one = mixing.plan(frame([(1, "a b c", "s")])).collect()[0]
    assert one.target == 3.0 and one.copies == 1


def test_rows_alike_are_drawn_one_by_one(frame):
    rows = [(None, "w x y", "hot") for _ in range(3000)] + [(i, "a b c d e f " * 9, "cold") for i in range(250)] + [(7, None, "hot")] * 50
    df = save(frame(rows).repartition(6), "docs")
    got = mixing.plan(df).collect()
    for source in ("hot", "cold"):
        own = [r for r in got if r.source == source]
        assert 0 < own[0].rate % 1 and sum(r.copies * r.size for r in own) == pytest.approx(own[0].target, rel=0.05)
    again = sorted(str((r.id, r.source, r.copies)) for r in mixing.plan(df).collect())
    assert again == sorted(str((r.id, r.source, r.copies)) for r in got)
    assert mixing.mix(df).count() == sum(r.copies for r in got)


def test_names_of_the_table_may_be_any(spark):
    names = ["source_", "NULL_", "rate_", "key_", "place_", "number_", "copy_", "__source"]
    df = spark.createDataFrame([(i, "a b", "s" if i % 2 else None, *range(8)) for i in range(20)],
                               "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.mix(df)
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {tuple(range(8))}
