"""Nearest neighbours against brute force, and synthetic rows on the segments of their own pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.operators import neighbours as NB

SF = "/root/testdata/sf0.1"


def brute(points, k):
    ids = sorted(points)
    out = {}
    for i in ids:
        d = sorted((float(np.sqrt(((np.array(points[i]) - np.array(points[j])) ** 2).sum())), j) for j in ids if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def table(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in points.items()], "id long, v array<double>")


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.neighbour)
    return out


@pytest.mark.parametrize("pivots,block", [(1, 512), (7, 512), (9, 8), (40, 4)])
def test_neighbours_equal_brute_force(spark, pivots, block):
    rng = np.random.default_rng(pivots)
    points = {i: rng.normal(size=3) + 5 * rng.integers(0, 3, 3) for i in range(150)}
    for i in range(150, 190):
        points[i] = points[3]  # a group of copies
    points[190], points[191] = points[5], np.array([1e6, 0, 0])
    got = found(NB.neighbours(table(spark, points), "id", "v", 5, pivots=pivots, block=block))
    assert got == brute(points, 5)


def test_few_rows(spark):
    for n in (0, 1, 2, 4):
        points = {i: [float(i), 0.0] for i in range(n)}
        got = found(NB.neighbours(table(spark, points), "id", "v", 5))
        assert got == {i: v for i, v in brute(points, 5).items() if v}


def test_recall_with_probes(spark):
    """Bounded probes on real vectors of all classes: recall at least 0.9."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    exact = found(NB.neighbours(e, "id", "v", 5))
    near = found(NB.neighbours(e, "id", "v", 5, probes=24))
    hit = sum(len(set(near[i]) & set(exact[i])) for i in exact) / sum(map(len, exact.values()))
    print(f"recall {hit:.3f}")
    assert hit >= 0.9


def test_synthetic_rows_lie_on_the_segment_of_their_pair(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").filter("label = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    points = {r.id: np.array(r.v, float) for r in e.collect()}
    near = brute(points, 5)
    rows = NB.synthetic(e, "id", "v", 500).collect()
    assert len(rows) == 500 and len({(r.id, r.copy) for r in rows}) == 500
    share = [sum(r.id == i for r in rows) for i in points]
    assert max(share) - min(share) <= 1
    for r in rows:
        assert r.neighbour in near[r.id] and 0 <= r.u < 1
        assert np.allclose(r.vector, points[r.id] + r.u * (points[r.neighbour] - points[r.id]), atol=1e-12)
    assert {r.neighbour != near[r.id][0] for r in rows} == {True, False}


def test_classes_are_equal_after_oversampling(spark):
    df = table(spark, {i: [i, i % 3, 1.0] for i in range(30)}).withColumn("label", (F.col("id") < 4).cast("int"))
    got = {(r.label, r.synthetic): r["count"] for r in NB.oversample(df, "id", "v").groupBy("label", "synthetic").count().collect()}
    assert got == {(0, False): 26, (1, False): 4, (1, True): 22}
    one = df.filter("id <> 0 AND id <> 1 AND id <> 2")
    alone = NB.oversample(one, "id", "v").filter("synthetic").distinct().collect()
    assert [r.vector for r in alone] == [[3.0, 0.0, 1.0]]
