"""Helpers of the training-data operators: shared tables and connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendlens.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path under the session's checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The written table cuts the lineage: it survives a lost executor, and what
    reads it twice computes it once.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most so many rows for what is written inside: a batch of long texts is
    held several times over, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


CROWD = 512  # rows of a key from which on it is treated as crowded ...
BROADCAST_KEYS = 100_000  # ... or more, so that there are at most so many crowded keys


def joined(left: DataFrame, right: DataFrame, on: list[str], total: int, least: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has a row per key and, in ``rows``, how many rows of ``left`` it meets.

    Keys that meet more than ``least`` rows (CROWD if not given), and more than a fixed share of all
    ``total`` rows, are broadcast: there are at most BROADCAST_KEYS of them. So
    no task gets a key of many rows."""
    crowd = max(least or CROWD, total // BROADCAST_KEYS)
    hot = F.broadcast(right.filter(F.col("rows") > crowd))
    rest = left.join(hot.select(*on), on, "left_anti").join(right.filter(F.col("rows") <= crowd), on)
    return left.join(hot, on).unionByName(rest)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), the smallest node of each.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    is one shuffle with a partial minimum per node, and the number of rounds
    grows with the logarithm of the longest chain. The edges are written to
    the shared folder every round; nothing but two counters reaches the
    driver. Nodes without an edge do not appear. Null ends and loops are
    ignored; an empty table gives an empty result.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    # every edge from its larger end u to its smaller end v
    cur = staged(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if not cur.head(1):
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # large star: the larger neighbours of u go to u's smallest neighbour
        ends = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = ends.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u's smaller neighbours and u itself go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v") \
            .unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        cur = staged(small, "edges")
        # done when every node either points to one root or is a root
        roles = cur.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
            .unionAll(cur.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))) \
            .groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not roles.filter("up > 1 OR (up > 0 AND down > 0)").head(1):
            roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def hash_sample(df: DataFrame, n: int) -> list:
    """At most ``n`` different rows, those with the smallest hashes.

    A first count sets a hash below which about 4 n rows lie, so that what
    reaches the driver stays as small as the sample, however many tasks there
    are. Fewer than ``n`` come back where most rows are copies."""
    total = df.count()
    h = F.xxhash64(*df.columns)
    if total > 4 * n:
        df = df.filter(h < F.lit(int(-(1 << 63) + 4 * n / total * (1 << 64))))
    return df.distinct().orderBy(h, *df.columns).limit(n).collect()


def smallest_rows(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
