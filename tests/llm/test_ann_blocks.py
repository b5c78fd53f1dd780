import numpy as np
import pytest

from pyspark.sql import functions as F

from hirelens.llm import ann_blocks


def brute(rows, k):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in ok:
        if i % 20 == 0:
            near = sorted((-float((q * v).sum()), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)}
    return out


def rows(n, dim, seed):
    rnd = np.random.default_rng(seed)
    data = rnd.normal(size=(n, dim)).astype(np.float32) * 10.0 ** rnd.integers(-2, 3, (n, 1))
    out = [(i, data[i].tolist()) for i in range(n)]
    out += [(n + i, data[5].tolist()) for i in range(9)]  # ties
    return out + [(2000, None), (2020, []), (2040, [0.0] * dim), (2060, [None] + [1.0] * (dim - 1)), (2080, [float("nan")] * dim), (2100, [float("inf")] * dim),
                  (2120, [1.0, 2.0]), (2121, [3.0, 1.0]), (None, [1.0] * dim), (2140, [1e-42] * dim)]


@pytest.mark.parametrize("n,dim,stripe", [(300, 16, 64), (500, 7, 10_000), (30, 3, 8)])
def test_matches_brute_force(spark, n, dim, stripe):
    data = rows(n, dim, n)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as stripe", "3 as query").repartition(3)
    got = ann_blocks.nearest(df, F.col("vec_id") % 20 == 0, stripe_rows=stripe).collect()
    as32 = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in data]
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got} == brute(as32, 20)


def test_bounds_hold():
    rnd = np.random.default_rng(0)
    a, b = (ann_blocks.Tile(np.arange(40) + 100 * i, rnd.normal(size=(40, 24)) * 10.0 ** rnd.integers(-3, 4, (40, 1))) for i in range(2))
    about = (a.int8.astype(float) @ b.int8.astype(float).T) * a.scale[:, None] * b.scale[None, :]
    slack = a.rest_norm[:, None] * b.norm + a.back_norm[:, None] * b.rest_norm
    assert (np.abs(a.rows @ b.rows.T - about) <= slack + 1e-9 * np.abs(about)).all()


def test_repeated_ids_are_candidates_but_not_their_own(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [2.0, 0.0]), (3, [5.0, 0.0]), (3, [4.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann_blocks.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert {r.vec_id for r in got} == {3}
    assert ann_blocks.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_products_of_many_dimensions_are_exact():
    # Whole numbers up to 127 leave no residual, so nothing but the product decides.
    rnd = np.random.default_rng(3)
    queries = np.full((20, 5000), 127.0) - rnd.integers(0, 3, (20, 5000))
    vectors = np.full((200, 5000), 127.0) - (rnd.random((200, 5000)) < 0.002)
    queries[:, 0] = vectors[:, 0] = 127.0
    heaps = [[] for _ in queries]
    ann_blocks.block_nearest(ann_blocks.Tile(1000 + np.arange(20), queries), ann_blocks.Tile(np.arange(200), vectors), heaps, 3)
    for q, heap in zip(queries, heaps):
        assert sorted(s for s, _ in heap) == sorted((vectors @ q).tolist())[-3:]
