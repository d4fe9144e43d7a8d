import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import neighbours


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        s = (x * x[ids == q][0]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 32))
    if kind == "clusters":
        x = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.2 * x
    if kind != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 40 == 0, 10, block_rows=1500).collect()
    want = brute(rows, range(0, 4000, 40), 10)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = sum(len({i for i, _ in by[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * 10 * len(want)
    for q, own in by.items():
        assert len(own) == 10 and own == sorted(own, key=lambda p: (-p[1], p[0]))
        assert all(np.isclose(s, np.float32(rows[i][1]).astype(float) @ np.float32(rows[q][1]).astype(float)) for i, s in own)


def test_ties_and_bad_rows(spark):
    v = [1.0, 2.0]
    rows = [(i, v) for i in range(1, 60)] + [(0, v), (60, v)]
    rows += [(100, None), (120, [0.0, 0.0]), (140, [1.0, None]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (200, []), (220, [1.0]), (None, v), (5, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as block", "2 as kind")
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert {r.query_id for r in out} == {0, 20, 40, 60} and all(r.score == 5.0 for r in out)
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 0] == list(range(1, 21))


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_each_size_is_searched_among_its_own(spark):
    rows = [(i, [1.0, float(i)]) for i in range(30)] + [(100 + i, [1.0, float(i % 7), 2.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    want = brute(rows[:30], [0, 20], 5) | brute(rows[30:], [100, 120], 5)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out} == {(q, k + 1, i, s) for q, own in want.items() for k, (i, s) in enumerate(own)}


def test_one_very_common_vector(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 16))
    x[::3] = x[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = neighbours.nearest(df, F.col("vec_id") % 300 == 0, 10, block_rows=1000).collect()
    for q in range(0, 6000, 300):  # of that vector all: the least ids
        own = [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q]
        assert own == [i for i in range(0, 60, 3) if i != q][:10]
