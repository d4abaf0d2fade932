"""Exact ranks, splits and folds over range partitions."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lendlens.operators import rank as R


def test_ranks_of_awkward_rows(spark):
    rows = [("a", i * 7 % 101, "x") for i in range(101)] + [("b", 1, "y")] * 40 + [(None, None, "z"), (None, 3, "z"), ("c", None, None), ("c", 2, "__rank_part")]
    df = spark.createDataFrame(rows, "g string, v int, rank string")
    got = R.ranked(df, ["g"], ["v"], "at", "n").collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r)
    for group in by.values():
        ordered = sorted(group, key=lambda r: r["at"])
        assert [r["at"] for r in ordered] == list(range(1, len(group) + 1)) and {r.n for r in group} == {len(group)}
        keys = [(r.v is not None, r.v or 0) for r in ordered]
        assert keys == sorted(keys)
    assert R.ranked(df.limit(0), ["g"], ["v"]).collect() == []


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.5, 1.0])
def test_split_counts_are_exact(spark, fraction):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") == 5, None).otherwise(0))
    got = Counter((r.label, r.split) for r in R.stratified_split(df, "id", "label", fraction).collect())
    for label, n in ((1, 100), (0, 899), (None, 1)):
        test = int(n * fraction + 0.5)
        assert (got[label, "test"], got[label, "train"]) == (test, n - test)
    again = R.stratified_split(df.repartition(13), "id", "label", fraction)
    assert set(again.collect()) == set(R.stratified_split(df, "id", "label", fraction).collect())


def test_folds_differ_by_one_row(spark):
    df = spark.range(503).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    got = Counter((r.label, r.fold) for r in R.stratified_folds(df, "id", folds=5).collect())
    for label in (0, 1):
        sizes = [got[label, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(n for (y, _), n in got.items() if y == label)


def test_no_group_is_one_window(spark):
    """The numbering window is split by range partitions, not by group alone."""
    df = spark.range(10_000).withColumn("g", F.lit(1))
    plan = R.ranked(df, ["g"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\\n") if "row_number" in line]
    assert windows and all("__rank_part" in line for line in windows)
