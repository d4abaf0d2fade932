"""Sliding and closed windows, and late rows counted over more batches than a query remembers."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lendlens.streaming import jobs as SJ

DAY = datetime(2024, 1, 1)
SCHEMA = "application_id string, timestamp timestamp, decision string, loan_amount double, gender string"


def files(spark, tmp_path, batches):
    """One file per batch, read in order of their names' times."""
    import os
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b={i:04d}")
        for f in os.listdir(f"{tmp_path}/in/b={i:04d}"):
            os.utime(f"{tmp_path}/in/b={i:04d}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def row(i, hours, decision="approved", gender="f"):
    return f"A{i}", DAY + timedelta(hours=hours), decision, 100.0 + i, gender


@pytest.fixture
def one_partition(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_late_rows_over_many_batches_are_exact(spark, tmp_path, one_partition):
    batches, late = [], 0
    for i in range(104):
        rows = [row(3 * i, 24 * i + 1)]
        if i >= 4:  # rows are late behind the watermark that the batch before began with
            rows += [row(3 * i + 1, 24 * (i - 4)), row(3 * i + 2, 24 * (i - 4) + 2)]
            late += 2
        batches.append(rows)
    stream = files(spark, tmp_path, batches)
    totals = SJ.run_counted(SJ.windowed_stats(stream), f"{tmp_path}/out", "update")
    final = SJ.read_final(spark, f"{tmp_path}/out", ["window_start"])
    assert totals["batches"] > 100 and totals["input"] == sum(map(len, batches))
    assert SJ.late_rows(final, totals) == late
    assert totals["dropped"] == late // 2  # two late rows of one window arrive as one partial group
    assert {r.predictions for r in final.collect()} == {1}


def test_closed_windows_equal_the_batch_answer(spark, tmp_path, one_partition):
    batches = [[row(10 * b + i, 24 * b + 5 * i, ["approved", "denied"][(b * i) % 2], "fmx"[i % 3]) for i in range(5)] for b in range(6)]
    stream = files(spark, tmp_path, batches)
    rows = [r for b in batches for r in b]
    closed = max(r[1] for r in rows) - timedelta(days=1)
    totals = SJ.closed_group_gaps(stream, f"{tmp_path}/gaps")
    got = SJ.read_final(spark, f"{tmp_path}/gaps").collect()
    want = Counter((r[1].date(), r[4]) for r in rows if datetime.combine(r[1].date(), datetime.min.time()) + timedelta(days=1) <= closed)
    assert Counter({(r.window_start.date(), r.group): r.n for r in got}) == want and len(got) == len(want) and totals["dropped"] == 0
    for r in got:
        same = [x for x in got if x.window_start == r.window_start]
        overall = sum(x.approved for x in same) / sum(x.n for x in same)
        assert r.overall_rate == pytest.approx(overall) and r.max_gap_to_overall == pytest.approx(max(abs(x.rate - overall) for x in same))
        assert r.dp_difference == pytest.approx(max(x.rate for x in same) - min(x.rate for x in same))
    # running the same query again after its checkpoint adds nothing
    SJ.closed_group_gaps(stream, f"{tmp_path}/gaps")
    assert len(SJ.read_final(spark, f"{tmp_path}/gaps").collect()) == len(want)


def test_sliding_windows_equal_the_batch_answer(spark, tmp_path, one_partition):
    batches = [[row(4 * b + i, 12 * b + i) for i in range(4)] for b in range(5)]
    stream = files(spark, tmp_path, batches)
    SJ.run_counted(SJ.windowed_stats(stream, "2 days", "3 days", "1 day"), f"{tmp_path}/slide", "update")
    got = {r.window_start: r.predictions for r in SJ.read_final(spark, f"{tmp_path}/slide", ["window_start"]).collect()}
    rows = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    batch = rows.groupBy(F.window("timestamp", "2 days", "1 day").alias("w")).count()
    assert got == {r.s: r["count"] for r in batch.select(F.col("w.start").cast("timestamp_ntz").alias("s"), "count").collect()}
