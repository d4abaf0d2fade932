"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

A bin never holds two pieces of one source or of one duplicate cluster. Bins
are ordered by their residual; a piece goes to the tightest compatible bin,
found by walking the residuals upward from its own size. The bitmaps that tell
which bins carry a source or a cluster are kept with one bit per bin, so that
one AND shows all compatible bins of a residual.

Pieces are dealt by hash into groups of about ``group`` pieces, and each group
is packed by itself: a bin never spans groups, so tasks stay small however
large the input or one source is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import staged

GROUP = 4096


def best_fit(sizes: list[int], conflicts: list[list], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece, in the order given. ``conflicts`` holds, per
    kind of conflict, each piece's value; null values conflict with nothing."""
    levels: dict[int, int] = {}  # residual -> bitmap of its bins
    open_levels = 0              # bitmap of the residuals in use
    carried: list[dict] = [{} for _ in conflicts]  # value -> bitmap of the bins that carry it
    bins, offsets, made = [], [], 0
    for i, size in enumerate(sizes):
        blocked = 0
        for kind, values in zip(carried, conflicts, strict=True):
            blocked |= kind.get(values[i], 0) if values[i] is not None else 0
        left, fit, residual = open_levels >> size, 0, size
        while left:
            step = (left & -left).bit_length() - 1
            residual = size + step
            fit = levels[residual] & ~blocked
            if fit:
                break
            left &= left - 1
        if fit:
            bit = fit & -fit
            levels[residual] ^= bit
            if not levels[residual]:
                open_levels ^= 1 << residual
        else:
            bit, residual, made = 1 << made, capacity, made + 1
        bins.append(bit.bit_length() - 1)
        offsets.append(capacity - residual)
        rest = residual - size
        levels[rest] = levels.get(rest, 0) | bit
        open_levels |= 1 << rest
        for kind, values in zip(carried, conflicts, strict=True):
            if values[i] is not None:
                kind[values[i]] = kind.get(values[i], 0) | bit
    return bins, offsets


def pack(docs: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "size",
         conflict_cols: tuple[str, ...] = ("source", "cluster"), group: int = GROUP) -> DataFrame:
    """(id, copy, piece, start, size, bin, offset): where every piece of every row goes.

    A row longer than ``capacity`` is cut into pieces of the capacity and a
    rest; ``start`` is the piece's first word in its row, ``offset`` its place in
    the bin. In each group the longest pieces go first, ties by id, copy and
    piece. A null or negative size counts as zero; a row of size zero is one
    empty piece. Null sources and clusters conflict with nothing. Equal rows
    are told apart by ``copy``; null ids are packed like others. An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"c{i}" for i in range(len(conflict_cols))]
    rows = docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"),
                       *[F.col(c).cast("string").alias(n) for c, n in zip(conflict_cols, names, strict=True)])
    rows = rows.groupBy("id", "n", *names).agg(F.count("*").alias("copies"))
    whole = F.lit(capacity).cast("long")
    pieces = F.greatest(F.ceil(F.col("n") / whole), F.lit(1))
    cut = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))) \
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))) \
        .withColumn("start", F.col("piece") * whole) \
        .withColumn("size", F.least(F.col("n") - F.col("start"), whole)).drop("n", "copies")
    cut = staged(cut, "pieces")
    groups = max(1, -(-cut.count() // group))

    def one(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["piece"].to_numpy(), table["copy"].to_numpy(), _rank(table["id"]), -table["size"].to_numpy()))
        table = table.take(pa.array(order))
        bins, offsets = best_fit(table["size"].to_pylist(), [table[n].to_pylist() for n in names], capacity)
        first = table["g"][0].as_py() << 32
        return pa.table([table["id"], table["copy"], table["piece"], table["start"], table["size"], pa.array([first + b for b in bins], pa.int64()),
                         pa.array(offsets, pa.int64())], names=["id", "copy", "piece", "start", "size", "bin", "offset"])

    dealt = cut.withColumn("g", F.pmod(F.xxhash64("id", "copy", "piece"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(one, f"id {kind}, copy long, piece long, start long, size long, bin long, offset long")


def _rank(column: pa.ChunkedArray) -> np.ndarray:
    """Sort keys of any id type, nulls first."""
    codes = column.combine_chunks().dictionary_encode()
    values = codes.dictionary
    order = np.empty(len(values) + 1, np.int64)
    order[np.asarray(pa.compute.sort_indices(values))] = np.arange(1, len(values) + 1)
    order[-1] = 0
    return order[np.asarray(codes.indices.fill_null(len(values)))]
