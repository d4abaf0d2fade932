"""Bucketed feature tables: joins without a shuffle, lookups that skip files and row groups."""

import pytest
from pyspark.sql import functions as F

from lendlens.sources import store as ST


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("features")
    ids = spark.range(0, 4000, 2).withColumnRenamed("id", "application_id")
    a = ids.withColumn("income", F.col("application_id") * 10)
    b = ids.filter("application_id % 3 = 0").withColumn("debt", F.col("application_id") + 1)
    return [ST.save_features(df, "application_id", path=f"{path}/{n}", buckets=8) for n, df in (("a", a), ("b", b))]


def test_join_needs_no_exchange(spark, tables):
    out = ST.join_features(spark, tables, "application_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    rows = out.collect()
    assert len(rows) == 2000
    assert all(r.income == 10 * r.application_id and r.debt == (r.application_id + 1 if r.application_id % 3 == 0 else None) for r in rows)


def test_lookup_opens_one_bucket_and_skips_row_groups(spark, tables):
    assert [r.income for r in ST.lookup(spark, tables[0], "application_id", [102]).collect()] == [1020]
    assert sorted(r.application_id for r in ST.lookup(spark, tables[0], "application_id", [4, 6, 7]).collect()) == [4, 6]

    def scanned(key):
        df = ST.lookup(spark, tables[0], "application_id", [key])
        execution = df._jdf.queryExecution()
        execution.executedPlan().executeCollect()
        leaf = execution.executedPlan().collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    # odd ids lie between the smallest and the largest of their bucket, and only the bloom filter knows that they are absent
    assert sum(scanned(k) for k in (1001, 1003, 1005, 2001, 2003, 3001)) == 0
    assert 0 < scanned(1002) < 2000 / 8 * 2  # one bucket of eight


def test_nulls_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, "c")], "k long, v string")
    t = ST.save_features(df, "k", path=f"{tmp_path}/t", buckets=4)
    assert sorted(r.v for r in spark.table(t).collect()) == ["a", "b", "c"]
    e = ST.save_features(df.limit(0), "k", path=f"{tmp_path}/e", buckets=4)
    assert ST.join_features(spark, [t, e], "k").count() == 3 and ST.lookup(spark, e, "k", [1]).collect() == []
