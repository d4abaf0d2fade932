"""Features stored for repeated joins and lookups by key.

A feature table is bucketed and sorted by its key, so tables with the same
number of buckets join without a shuffle on either side, and a lookup opens the
buckets of its ids alone; there Parquet bloom filters skip row groups that do
not hold an id, which the key's minimum and maximum cannot tell.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.session import ensure_checkpoint_dir

BUCKETS = 64


def save_features(df: DataFrame, key: str, name: str | None = None, path: str | None = None, buckets: int = BUCKETS, rows: int | None = None) -> str:
    """Write ``df`` as a table bucketed by ``key``; returns the table's name.

    The rows are shuffled once, by the key into as many tasks as buckets, so each bucket is one sorted file. ``rows`` is the expected
    number of keys, for the bloom filters' size (counted if not given). Without a ``path`` the files go under the session's checkpoint folder."""
    spark = df.sparkSession
    name = name or f"features_{uuid.uuid4().hex}"
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/features/{name}"
    rows = df.count() if rows is None else rows
    df.repartition(buckets, key).sortWithinPartitions(key).write.format("parquet").bucketBy(buckets, key).sortBy(key) \
        .option("path", path).option(f"parquet.bloom.filter.enabled#{key}", "true") \
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(1, 2 * rows // buckets))).mode("overwrite").saveAsTable(name)
    return name


def join_features(spark: SparkSession, tables: list[str], key: str, how: str = "left") -> DataFrame:
    """Saved tables side by side, the first one's keys leading; neither side is shuffled."""
    out = spark.table(tables[0])
    for t in tables[1:]:
        out = out.join(spark.table(t).hint("merge"), key, how)
    return out


def lookup(spark: SparkSession, table: str, key: str, ids: list) -> DataFrame:
    """The rows of some ids, read from their buckets' matching row groups."""
    return spark.table(table).filter(F.col(key).isin(ids))
