import numpy as np
from pyspark.sql import functions as F

from ferngraph.llm import permutation_index, va_search


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit(2))


def sample(n=300, dim=16, seed=0):
    x = np.random.default_rng(seed).normal(0, 0.3, (n, dim)).astype(np.float32)
    x[50:90] = x[50]  # a group of copies
    return [(k, x[k].tolist()) for k in range(n)]


ODD = [(1000, None), (1020, [float("nan")] * 16), (1040, [None] * 16), (1060, [float("inf")] * 16), (1080, [1.0] * 3), (None, [1.0] * 16), (1100, [])]


def test_exact_top_k(spark):
    rows = sample()
    got = {}
    for r in va_search.top_k(vectors(spark, rows + ODD), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.floor(64 * np.array([e for _, e in rows], np.float32).astype(float)).astype(int)
    for q in range(0, 300, 20):
        s = x @ x[q]
        order = [k for k in np.lexsort((np.arange(300), -s)) if k != q][:20]
        assert sorted(got[q]) == [(n + 1, k, s[k]) for n, k in enumerate(order)]
    assert set(got) == set(range(0, 300, 20))
    assert va_search.top_k(vectors(spark, ODD[:2]), F.lit(True)).count() == 0
    assert va_search.top_k(vectors(spark, rows[:3]), F.col("vec_id") == 0).count() == 2


def test_exact_beyond_doubles(spark):
    rows = [(0, [3e12, 1.0]), (1, [3e12, 2.0]), (2, [3e12, 1.0]), (3, [-3e12, 5.0])]
    got = [(r.vec_id, r.score) for r in va_search.top_k(vectors(spark, rows), F.col("vec_id") == 0, scale=1.0).orderBy("rank").collect()]
    exact = {k: sum(int(np.floor(float(np.float32(a)))) * int(np.floor(float(np.float32(b)))) for a, b in zip(rows[0][1], rows[k][1], strict=True)) for k in (1, 2, 3)}
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert got == [(k, cut(exact[k])) for k in sorted(exact, key=lambda k: (-exact[k], k))]


def test_exact_of_large_floats(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e17, 1.0]), (2, [1.5e17, 1.0]), (3, [1e30, 0.0])]
    got = [(r.vec_id, r.score) for r in va_search.top_k(vectors(spark, rows), F.col("vec_id") == 0, scale=1.0).orderBy("rank").collect()]
    exact = {k: int(float(np.float32(rows[k][1][0]))) for k in (1, 2, 3)}
    assert got == [(3, (1 << 63) - 1), (2, exact[2]), (1, exact[1])]


def test_searches_with_repeated_ids_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.5])]
    got = va_search.top_k(vectors(spark, rows), F.col("vec_id") == 3, k=4, scale=2.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 2), (0, -4), (1, -4), (1, -4)]
    got = permutation_index.nearest(vectors(spark, rows), F.col("vec_id") == 2, k=4, share=1.0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 9)) for r in got] == [(0, 1.0), (1, 1.0), (1, 1.0), (0, 0.0)]


def test_permutation_index(spark):
    rows = sample(n=2000)
    table = vectors(spark, [*rows, *ODD, (2020, [0.0] * 16)])
    x = np.array([e for _, e in rows], np.float32).astype(float)
    norm = np.sqrt((x * x).sum(1))
    found = permutation_index.nearest(table, F.col("vec_id") % 50 == 0, share=0.15)
    got, hits = {}, 0
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 2000, 50):
        s = x @ x[q] / (norm * norm[q])
        s[q] = -2
        top = np.lexsort((np.arange(2000), -np.round(s, 12)))[:5]
        hits += len({v for _, v, _ in got[q]} & set(top.tolist()))
        assert all(abs(s[v] - c) < 1e-9 for _, v, c in got[q]) and [n for n, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
    assert set(got) == set(range(0, 2000, 50)) and hits / (5 * len(got)) >= 0.9
    assert permutation_index.nearest(vectors(spark, ODD[:2]), F.lit(True)).count() == 0


def test_permutation_index_reranks_its_share(spark):
    n = 2000
    rows = sample(n=n, seed=3)
    x = np.array([e for _, e in rows], np.float32).astype(float)
    norm = np.sqrt((x * x).sum(1))
    table = vectors(spark, rows).repartition(3)

    def recall(share):
        got = permutation_index.nearest(table, F.col("vec_id") % 50 == 0, share=share).collect()
        assert len(got) == 5 * n // 50
        hits = 0
        for q in range(0, n, 50):
            s = np.delete(x @ x[q] / (norm * norm[q]), q)
            hits += sum(r.score >= np.sort(s)[-5] - 1e-9 for r in got if r.query_id == q)
        return hits / len(got)

    assert recall(0.004) < recall(permutation_index.SHARE) and recall(permutation_index.SHARE) >= 0.9


def test_permutation_index_of_few_vectors(spark):
    rows = sample(n=100)[:20]
    got = permutation_index.nearest(vectors(spark, rows), F.col("vec_id") == 19).collect()
    assert len(got) == 5 and all(r.vec_id != 19 for r in got)
    assert permutation_index.nearest(vectors(spark, rows[:3]), F.col("vec_id") == 0).count() == 2
