"""Exact row numbers per group without one window for a whole group.

Rows are range-partitioned by (group, order), numbered inside their partition
and shifted by the rows that earlier partitions hold of the same group. A
group of any share of the rows is spread over as many partitions as it needs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.session import ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, so that what reads it twice sees the same rows."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, by: list[str], order: list[Column | str], out: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with the row's number (from 1) among the rows of its group, as a long, and in ``total`` the group's size.

    Nulls form a group of their own. Rows equal in group and order are numbered
    in any order; give enough order columns where that matters. Columns of ``df`` may have any
    names but the new ones and those that start with ``__rank``.
    """
    cols = df.columns
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    order_names = [f"__rank_o{i}" for i in range(len(keys))]
    rows = df.withColumns(dict(zip(order_names, keys, strict=True)) | {"__rank_tie": F.monotonically_increasing_id()})
    placed = rows.repartitionByRange(*by, *order_names, "__rank_tie").withColumn("__rank_part", F.spark_partition_id())
    placed = written(placed, "ranges")
    sizes = placed.groupBy(*by, "__rank_part").agg(F.count(F.lit(1)).alias("__rank_n"))
    # a row per partition that holds part of the group
    earlier = Window.partitionBy(*by).orderBy("__rank_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"__rank_before": F.coalesce(F.sum("__rank_n").over(earlier), F.lit(0)),
                               "__rank_all": F.sum("__rank_n").over(Window.partitionBy(*by))})
    own = Window.partitionBy(*by, "__rank_part").orderBy(*order_names, "__rank_tie")
    numbered = placed.withColumn("__rank_at", F.row_number().over(own))
    before = sizes.select(*[F.col(c).alias(f"__rank_b{i}") for i, c in enumerate(by)], F.col("__rank_part").alias("__rank_p"), "__rank_before", "__rank_all")
    same = F.col("__rank_part") == F.col("__rank_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__rank_b{i}"))
    found = [(F.col("__rank_at") + F.col("__rank_before")).cast("long").alias(out)]
    if total:
        found.append(F.col("__rank_all").alias(total))
    return numbered.join(before, same).select(*cols, *found)



def _hash_order(key: str, label: str, seed: int) -> list[Column]:
    return [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col(label).cast("string"), F.lit(str(seed))).cast("binary")), F.col(key)]


def stratified_split(df: DataFrame, key: str, label: str = "label", test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: of every class exactly the share ``test_fraction`` of its rows, rounded to the
    nearest row, is "test" -- those whose key hashes come first -- and the rest "train"."""
    rows = ranked(df, [label], _hash_order(key, label, seed), "__split_rank", "__split_n")
    chosen = F.col("__split_rank") <= F.floor(F.col("__split_n") * F.lit(test_fraction) + 0.5)
    return rows.withColumn("split", F.when(chosen, "test").otherwise("train")).drop("__split_rank", "__split_n")


def stratified_folds(df: DataFrame, key: str, label: str = "label", folds: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """``df`` with the row's fold, from 0; the folds of a class differ by one row at most."""
    rows = ranked(df, [label], _hash_order(key, label, seed), "__fold_rank")
    return rows.withColumn(out, ((F.col("__fold_rank") - 1) % folds).cast("int")).drop("__fold_rank")
