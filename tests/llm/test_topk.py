import math
import random

import numpy as np
from pyspark.sql import functions as F

from gaugemill.llm import topk as t

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(rows, k, asked):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if asked(i)}):
        a = min(v for i, v in ok if i == q)
        best = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok if i != q and len(v) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force_over_many_blocks(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) * (3 if j < 4 else 0.2) for j in range(20)], 0) for i in range(300)] + [(i, [1.0, -2.0], 0) for i in range(300, 330)]
    df = spark.createDataFrame(rows, VECTORS)
    want = plain(rows, 4, lambda i: i % 10 == 0)
    for how in ({"step": 3}, {"round_": 70, "first": 9}, {"step": 64, "first": 0}):  # one round and many, with and without first bounds
        assert sorted(map(tuple, t.top_k(df.repartition(5), df.where("vec_id % 10 = 0"), k=4, **how).collect())) == want


def test_odd_vectors(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, None, 1), (3, [], 1), (4, [0.1, None, 0.2], 1), (5, [float("nan"), 0.0, 0.0], 1), (6, [float("inf"), 0.0, 0.0], 1), (7, [0.0, 0.0, 0.0], 1), (50, v, 1), (50, v, 2), (None, v, 1), (100, [1.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"dim": F.lit(1), "block": F.lit(2), "q": F.lit(3), "score": F.lit(4)})
    got = sorted(map(tuple, t.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    assert got == plain(rows, 5, lambda i: i % 50 == 0)
    assert t.top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [1e6 + i, -1e6 + 3 * i], 0) for i in range(0, 40)]
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted(map(tuple, t.top_k(df, df.where("vec_id % 20 = 0"), k=3).collect())) == plain(rows, 3, lambda i: i % 20 == 0)


def test_scores_beyond_a_long_are_ranked_exactly_and_cut_to_the_nearest_long(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1, 1]) * 10.0 ** rnd.choice([3, 9, 17, 17, 40, 300]), rnd.gauss(0, 1e17)], 0) for i in range(60)] + [(60, [1.7e308, -1.7e308], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, t.top_k(df.repartition(3), df.where("vec_id % 20 = 0"), k=50).collect()))
    exact = lambda v: [int(x) * 256 if abs(x) > 1e15 else math.floor(x * 256) for x in v]
    want = []
    for q, v, _ in rows[::20]:
        best = sorted((-sum(x * y for x, y in zip(exact(v), exact(w))), i) for i, w, _ in rows if i != q)[:50]
        want += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_large_and_missing_ids_are_exact(spark):
    rows = [(2**53 + 1 + 2 * i, [float(i), 1.0], 0) for i in range(20)] + [(None, [1.0, 1.0], 0), (-(2**62) - 1, [5.0, 1.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    asked = lambda i: i == 2**53 + 5
    assert sorted(map(tuple, t.top_k(df, df.where(f"vec_id = {2**53 + 5}")).collect())) == plain(rows, 5, asked)


def test_candidates_are_pruned_before_all_dimensions_are_read():
    rng = np.random.default_rng(1)
    v = np.vstack([rng.normal(0, 2, (4, 200)), rng.normal(0, 0.01, (60, 200))]).T
    q = t.Queries(np.array([0]), v[:1], 8)
    best, read = t.Best(5, np.full(1, -np.inf)), []
    t.scan(q, best, np.arange(1, 100), v[1:100])

    class Counted(np.ndarray):
        def __getitem__(self, item):
            out = super().__getitem__(item)
            if isinstance(item, tuple) and isinstance(item[1], np.ndarray):
                read.append(item[1].size)
            return out

    real, t.np.ascontiguousarray = t.np.ascontiguousarray, lambda x: real(x).view(Counted)
    try:
        t.scan(q, best, np.arange(100, 200), v[100:])
    finally:
        t.np.ascontiguousarray = real
    scores = np.floor(v * 256) @ np.floor(v[0] * 256)
    assert best.id.tolist() == sorted(range(1, 200), key=lambda i: (-scores[i], i))[:5]
    assert not read or read[0] < 50  # the bound from the first block leaves few
