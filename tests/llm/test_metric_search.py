import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.llm import metric_search as ms


def plain(rows, queries, k):
    vecs = [(i, v) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v)]
    out = set()
    for qi, q in dict.fromkeys((i, tuple(v)) for i, v in queries if i is not None and v is not None and None not in v):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vecs if i != qi)
        out |= {(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, vec array<long>, key string, score int")


@pytest.mark.parametrize("shape", ["clusters", "ties", "few"])
def test_equals_comparing_all(spark, shape):
    rng = random.Random(shape)
    if shape == "clusters":
        centres = [[rng.randrange(-200, 200) for _ in range(6)] for _ in range(5)]
        rows = [(i, [c + rng.randrange(-20, 20) for c in centres[i % 5]]) for i in range(400)]
    elif shape == "ties":
        rows = [(i, [rng.randrange(-1, 2) for _ in range(3)]) for i in range(300)] + [(i, [5, 5, 5]) for i in range(300, 420)]
    else:
        rows = [(0, [1, 2]), (50, [3, -1])]
    rows += [(1000, None), (1050, [1, None, 2]), (None, [1, 2, 3]), (1100, []), (1150, [4]), rows[0]]
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0] + [rows[0]]
    got = ms.top_k(frame(spark, rows), frame(spark, queries), 5, page=8, fanout=3, n_pivots=7)
    assert {tuple(r) for r in got.collect()} == plain(rows, queries, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_bounds_avoid_most_of_the_work():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (16, 8))
    vecs = np.concatenate([c + rng.integers(-30, 30, (256, 8)) for c in centres]).astype(np.int64)
    m2 = float((vecs.astype(float) ** 2).sum(1).max())
    px = centres.astype(np.float64)
    rows = []
    for g in range(16):
        own = vecs[256 * g:256 * (g + 1)]
        batch = ms._node_row(own, [[int(i)] for i in range(256 * g, 256 * (g + 1))], g, px, ms.lift(px, m2), m2, 32)
        rows += batch.to_pylist()
    tree = ms.Tree(rows, 8, m2, vecs[::300])
    tree.px, tree.pz = px, ms.lift(px, m2)
    for q in vecs[::500]:
        tree.computed = 0
        best = tree.search(q, 6)
        scores = vecs @ q
        assert [s for s, _ in best] == sorted(scores.tolist(), reverse=True)[:6]
        assert tree.computed < len(vecs) / 2


def test_empty_and_unusable_vectors(spark):
    empty = frame(spark, [])
    assert ms.top_k(empty, frame(spark, [(1, [1])])).collect() == []
    assert ms.top_k(frame(spark, [(1, [1])]), empty).collect() == []
    df = spark.createDataFrame([(1, [1.0, math.nan]), (2, [math.inf]), (3, None), (4, [0.1, -0.1]), (5, [1.0, None]), (6, [])], "vec_id long, e array<float>")
    assert [tuple(r) for r in df.filter(ms.usable("e")).select("vec_id", ms.quantised("e")).orderBy("vec_id").collect()] == [(4, [25, -26]), (6, [])]
    assert df.filter(F.col("vec_id") < 0).count() == 0
