"""The log holds every application once, whatever is run again."""

from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from lendlens.operators import log as LG


def rows(spark, ids, day=1, probability=0.1):
    return spark.createDataFrame([(i, None if i is None else f"APP{i}", datetime(2024, 1, day, 12), probability) for i in ids],
                                 "id long, application_id string, timestamp timestamp_ntz, probability double")


def logged(spark, path):
    return Counter((r.application_id, r.probability) for r in LG.scan_log(spark, path).collect())


def test_a_run_repeated_leaves_one_copy(spark, tmp_path):
    path = f"{tmp_path}/log"
    both = rows(spark, [1, 2]).unionByName(rows(spark, [3], day=2))
    LG.append_log(both, path, "monday")
    LG.append_log(both, path, "monday")
    assert logged(spark, path) == Counter({("APP1", 0.1): 1, ("APP2", 0.1): 1, ("APP3", 0.1): 1})
    assert LG.scan_log(spark, path, "2024-01-02 00:00:00").count() == 1


def test_ids_of_other_runs_are_left_out(spark, tmp_path):
    path = f"{tmp_path}/log"
    LG.append_log(rows(spark, [1, 2]), path)
    LG.append_log(rows(spark, [2, 3], day=5, probability=0.7), path)
    assert logged(spark, path) == Counter({("APP1", 0.1): 1, ("APP2", 0.1): 1, ("APP3", 0.7): 1})


def test_repeats_inside_a_run_and_rows_without_an_id(spark, tmp_path):
    path = f"{tmp_path}/log"
    df = rows(spark, [4, 4], day=3, probability=0.9).unionByName(rows(spark, [4], day=2, probability=0.2)).unionByName(rows(spark, [None, None]))
    LG.append_log(df, path, "r")
    LG.append_log(df, path, "r")
    assert logged(spark, path) == Counter({("APP4", 0.2): 1, (None, 0.1): 2})
    LG.append_log(df.limit(0), f"{tmp_path}/empty")
    assert LG.scan_log(spark, path).filter(F.col("log_date").isNull()).count() == 0
