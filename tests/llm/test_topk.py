import math
import random

from digestry.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, queries, k):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    good = [(i, ints(v)) for i, v, _ in rows if i is not None and ints(v) is not None]
    out = []
    for q, v in sorted({(i, tuple(map(float, v))) for i, v, _ in queries if i is not None and ints(v) is not None}):
        v = ints(v)
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


def check(spark, rows, every=5, k=5, n=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(n)
    got = topk.top_k(df, df.filter(f"vec_id % {every} = 0"), k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute(rows, [r for r in rows if r[0] is not None and r[0] % every == 0], k)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def vectors(n, dims, seed):
    pick = random.Random(seed)
    return [(i, [pick.gauss(0, 0.3) for _ in range(dims)], "clash") for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 64)
    check(spark, vectors(600, 40, 1))


def test_ties_copies_and_hot_vectors(spark):
    rows = vectors(100, 16, 2)
    rows += [(1000 + i, rows[3][1], "x") for i in range(200)] + [rows[5]] * 3
    check(spark, rows)


def test_bad_vectors_and_other_lengths(spark):
    rows = vectors(60, 3, 3) + [(200, None, "x"), (205, [1.0, None, 2.0], "x"), (210, [1.0, math.nan, 0.0], "x"), (215, [math.inf, 0.0, 0.0], "x")]
    rows += [(None, [1.0, 1.0, 1.0], "x"), (220, [0.5, 0.5], "x"), (221, [0.1, -0.5], "x"), (225, [], "x"), (226, [], "x"), (230, [-0.001] * 3, "x")]
    check(spark, rows)


def test_large_components_stay_exact(spark):
    check(spark, [(i, [1e6 + i / 512, -1e6, 3e5 * i], "x") for i in range(30)])


def test_several_rounds_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROUND_BYTES", 2000)
    rows = vectors(200, 20, 4)
    check(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert topk.top_k(df, df.limit(0), 5).count() == 0
    assert topk.top_k(df.limit(0), df, 5).count() == 0
    assert topk.top_k(df.limit(1), df.limit(1), 5).count() == 0


def test_slices_of_queries_give_the_same_result(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(5)
    queries, matrix = np.floor(draw.normal(0, 80, (37, 40))), np.floor(draw.normal(0, 80, (300, 40)))
    found = []
    for products in (1, 300 * 5, 10**9):
        monkeypatch.setattr(topk, "PRODUCTS", products)
        asked = topk.Queries(np.arange(37), queries, 5)
        asked.meet(np.arange(100, 400), matrix)
        found.append(list(asked.rows()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 37 * 5


def test_components_too_large_to_scale_take_no_part(spark):
    rows = [(0, [1.0, 2.0], "x"), (1, [3.0, 1.0], "x"), (5, [1e308, 0.0], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in topk.top_k(df, df, 5).orderBy("query_id").collect()] == [(0, 1, 1, 5 * 65536), (1, 1, 0, 5 * 65536)]
