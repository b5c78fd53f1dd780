import hashlib
import re

from pyspark.sql import functions as F

from hirelens.llm import exact_dedup

ROWS = [(1, "a b", "s"), (2, "ab", "s"), (3, "a  b ", "s"), (4, None, "s"), (5, "", None), (6, " \t\n", "s"),
        (7, "é x", "s"), (8, "éx", "s"), (9, "z" * 200_000, "s"), (10, "z" * 200_000, "s"), (None, "ab", "s"),
        (11, "same", "s"), (11, "same", "s"), (-5, "ab ", "s"), (None, "only", "s")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in rows]
    out = []
    for (i, t, _), n in zip(rows, norm):
        group = [(-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]) for r, m in zip(rows, norm) if m == n]
        out.append((i, min(group)[3], len(group), hashlib.sha256(n.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_matches_brute_force_and_keeps_one_of_each(frame):
    df = frame(ROWS).repartition(5)
    got = exact_dedup.assign(df, salts=3).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(brute(ROWS), key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})


def test_a_weak_digest_never_merges_texts(frame):
    df = frame(ROWS).repartition(4)
    weak = exact_dedup.assign(df, digest=lambda norm: F.length(norm).cast("string").cast("binary"))
    strong = exact_dedup.assign(df)
    cols = ["id", "keep_id", "group_size", "text_sha256"]
    assert sorted(map(tuple, weak.select(cols).collect()), key=key) == sorted(map(tuple, strong.select(cols).collect()), key=key)


def test_dedup_keeps_columns_and_one_row_per_text(frame):
    df = frame(ROWS)
    out = exact_dedup.dedup(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in ROWS})
    assert [r.doc_id for r in got if r.text == "a  b "] == [3]


def test_no_python_in_the_plan(frame):
    plan = exact_dedup.assign(frame(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(frame):
    assert exact_dedup.assign(frame([])).count() == 0 and exact_dedup.dedup(frame([])).count() == 0


def test_many_rows_without_an_id(frame):
    rows = [(None, "same  text", "s")] * 500 + [(None, "sametext ", "s")] * 40 + [(3, "sametext", "s")]
    got = exact_dedup.assign(frame(rows).repartition(5)).collect()
    assert len(got) == 541 and sum(r.kept for r in got) == 1
    assert {(r.group_size, r.keep_id) for r in got} == {(541, None)} and [r.length for r in got if r.kept] == [10]


def test_names_of_the_table_may_be_any(spark):
    df = spark.createDataFrame([(i % 3 or None, "a b" if i < 6 else f"t{i}", 1, 2, 3, 4) for i in range(9)],
                               "doc_id long, text string, key_ int, SHA_ int, `__id` int, null_ int")
    out = exact_dedup.dedup(df)
    assert out.columns == df.columns and out.count() == 4
