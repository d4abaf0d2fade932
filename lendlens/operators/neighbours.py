"""Nearest neighbours within a table, and synthetic minority rows between them.

Distinct vectors are dealt to the cells of pivots, a hash sample, and cells are cut into
blocks of bounded size, so a crowded region is many blocks. First every block is
searched within itself, which bounds how far a row's k-th neighbour can be. Then a
block is compared with each other block that some of its rows may have a closer
neighbour in: the border between two cells is (d(x, q)^2 - d(x, p)^2) / (2 d(p, q))
away from a row x of pivot p, and the rows of pivot q lie between two radii. A
pair of blocks is one row and one unit of work. Copies of a vector are searched once.

With ``probes`` None the neighbours are exact; with a number, a block visits
only that many cells, those nearest by the bounds, and the work grows with the
power 1.5 of the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.operators.rank import ranked, written

BLOCK = 512  # vectors of a block
MAX_PIVOTS = 4096


def _first(df: DataFrame, by: list[str], order: list, n: int, out: str) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= n)


def _pivots(vectors: DataFrame, total: int, pivots: int | None) -> np.ndarray:
    n = min(MAX_PIVOTS, pivots or max(1, round(total ** 0.5)))
    h = F.xxhash64("vec", F.lit(7))
    if total > 4 * n:
        vectors = vectors.filter(h < F.lit(int(-(1 << 63) + 4 * n / total * (1 << 64))))
    return np.array([r["vec"] for r in vectors.select("vec", h.alias("h")).orderBy("h").limit(n).collect()], np.float64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact where it counts: differences, not the square expansion, so that copies are at 0. Rows of x one at a time."""
    return np.sqrt(np.stack([((row - y) ** 2).sum(1) for row in x])) if len(x) else np.zeros((0, len(y)))


def _matrix(column) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vid, vec, cell, r): every vector with its nearest pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                d = _distances(_matrix(part.column(1)), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])],
                                                 names=["vid", "vec", "cell", "r"])

    return vectors.mapInArrow(run, f"vid {dict(vectors.dtypes)['vid']}, vec array<double>, cell int, r double")


def _nearest(d: np.ndarray, ids: list, k: int) -> Iterator[tuple[int, int]]:
    """(row, column) of the k smallest distances of each row, ties by id."""
    order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(ids, kind="stable")), d.shape), d))[:, :k]
    for i, cols in enumerate(order):
        for j in cols[np.isfinite(d[i, cols])]:
            yield i, int(j)


def _inside(blocks: DataFrame, k: int, id_type: str) -> DataFrame:
    """(vid, other, dist) within each block."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vids").combine_chunks().flatten().to_pylist()
        x = np.asarray(table.column("flat").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1)
        d = _distances(x, x)
        np.fill_diagonal(d, np.inf)
        found = list(_nearest(d, ids, k))
        return pa.table({"vid": pa.array([ids[i] for i, _ in found], table.schema.field("vids").type.value_type),
                         "other": pa.array([ids[j] for _, j in found], table.schema.field("vids").type.value_type),
                         "dist": pa.array([float(d[i, j]) for i, j in found], pa.float64())})

    return blocks.groupBy("block").applyInArrow(run, f"vid {id_type}, other {id_type}, dist double")


def neighbours(df: DataFrame, id_col: str, vector_col: str, k: int = 5, probes: int | None = None, pivots: int | None = None,
               block: int = BLOCK) -> DataFrame:
    """(id, rank, neighbour, distance): the ``k`` nearest other rows of every row, ties by the smaller id.

    Ids are unique and not null, vectors have one length and hold no null. Fewer than k come
    back where there are fewer other rows; an empty table gives an empty result."""
    id_type = dict(df.dtypes)[id_col]
    rows = written(df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec")), "vectors")
    # of copies, k + 1 are enough to name everyone's neighbours
    copies = _first(rows, ["vec"], ["id"], k + 1, "place").groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = written(copies.select(F.col("ids")[0].alias("vid"), "vec", "ids"), "distinct-vectors")
    total = vectors.count()
    schema = f"id {id_type}, rank int, neighbour {id_type}, distance double"
    if not total:
        return df.sparkSession.createDataFrame([], schema)
    centres = _pivots(vectors.select("vec"), total, pivots)
    placed = written(_cells(vectors.select("vid", "vec"), centres), "cells")
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    parts = F.element_at(F.create_map(*[x for c, r in stats.items() for x in (F.lit(c), F.lit(-(-r["n"] // block)))]), F.col("cell"))
    blocks = placed.withColumn("part", F.pmod(F.xxhash64("vid"), parts)) \
        .groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("vid", "vec", "r"))).alias("m")) \
        .select(F.concat_ws(":", "cell", "part").alias("block"), "cell", F.col("m.vid").alias("vids"), F.flatten("m.vec").alias("flat"), F.col("m.r").alias("rs"))
    blocks = written(blocks, "blocks")
    near = written(_inside(blocks, k, id_type), "near-inside")
    bounds = near.groupBy("vid").agg(F.count("*").alias("n"), F.max("dist").alias("d"))
    limit = placed.select("vid", "vec", "cell").join(bounds, "vid", "left") \
        .select("vid", "vec", "cell", F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf"))).alias("ub"))

    # cells that rows of a cell must look into, with the smallest bound; at most cells x cells rows
    centre_gap = _distances(centres, centres)
    lo = np.array([stats[c]["lo"] if c in stats else np.inf for c in range(len(centres))])
    hi = np.array([stats[c]["hi"] if c in stats else -np.inf for c in range(len(centres))])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], float] = {}
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                own, ub = part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False)
                d = _distances(_matrix(part.column(1)), centres)
                home = d[np.arange(len(d)), own][:, None]
                gap = np.where(centre_gap[own] > 0, centre_gap[own], np.inf)
                low = np.maximum(np.maximum((d ** 2 - home ** 2) / (2 * gap), d - hi), np.maximum(lo - d, 0))
                low = np.where(np.isfinite(lo), low * (1 - 1e-9), np.inf)
                low[np.arange(len(d)), own] = 0.0
                if probes is not None and probes < low.shape[1]:
                    low[low > np.partition(low, probes - 1, axis=1)[:, probes - 1:probes]] = np.inf
                for i, j in zip(*np.nonzero((low <= ub[:, None]) & np.isfinite(low)), strict=True):
                    pair = int(own[i]), int(j)
                    best[pair] = min(best.get(pair, np.inf), low[i, j])
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in best], pa.int32()), pa.array([p[1] for p in best], pa.int32())], names=["from_cell", "to_cell"])

    wanted = limit.mapInArrow(visits, "from_cell int, to_cell int").distinct()
    left = blocks.select(F.col("cell").alias("from_cell"), F.col("block").alias("from_block"), F.col("vids").alias("a"), F.col("flat").alias("x"))
    right = blocks.select(F.col("cell").alias("to_cell"), F.col("block").alias("to_block"), F.col("vids").alias("b"), F.col("flat").alias("y"))
    pairs = wanted.join(left, "from_cell").join(right, "to_cell").filter("from_block <> to_block")

    def across(table: pa.Table) -> pa.Table:
        a, b = [table.column(c).combine_chunks().flatten().to_pylist() for c in ("a", "b")]
        x, y = [np.asarray(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(n, -1) for c, n in (("x", len(a)), ("y", len(b)))]
        d = _distances(x, y)
        found = list(_nearest(d, b, k))
        kind = table.schema.field("a").type.value_type
        return pa.table({"vid": pa.array([a[i] for i, _ in found], kind), "other": pa.array([b[j] for _, j in found], kind),
                         "dist": pa.array([float(d[i, j]) for i, j in found], pa.float64())})

    more = pairs.groupBy("to_cell", "from_block", "to_block").applyInArrow(across, f"vid {id_type}, other {id_type}, dist double")
    best = _first(near.unionAll(more), ["vid"], ["dist", "other"], k, "place")
    ids = vectors.select(F.col("vid").alias("other"), F.col("ids").alias("other_ids"))
    cells = F.transform("other_ids", lambda i: F.struct(F.col("dist"), i.alias("id")))
    lists = best.join(ids, "other").select("vid", cells.alias("cells")).groupBy("vid").agg(F.flatten(F.collect_list("cells")).alias("others"))
    own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("id")))
    every = vectors.join(lists, "vid", "left").select("vec", F.concat(own, F.coalesce("others", F.array().cast(f"array<struct<dist:double,id:{id_type}>>"))).alias("all"))
    cells = F.slice(F.array_sort(F.filter("all", lambda c: c["id"] != F.col("id"))), 1, k)
    return rows.join(every, "vec").select("id", F.posexplode(cells).alias("p", "c")) \
        .select("id", (F.col("p") + 1).alias("rank"), F.col("c.id").alias("neighbour"), F.col("c.dist").alias("distance"))


def _fraction(*cols: Column | str) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / float(1 << 52)).cast("double")


def synthetic(minority: DataFrame, id_col: str, vector_col: str, missing: int, k: int = 5, seed: int = 42, probes: int | None = None) -> DataFrame:
    """(id, copy, neighbour, u, vector): ``missing`` synthetic rows between rows of ``minority`` and one of their k nearest.

    Every row yields as many, the first ones by hash one more; the neighbour and u in [0, 1) come from hashes of the
    id, the copy's number and ``seed``. A row without a neighbour is repeated."""
    rows = minority.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = written(ranked(rows.withColumn("g", F.lit(0)), ["g"], [F.xxhash64("id", F.lit(seed)), "id"], "at", "n").drop("g"), "minority")
    near = neighbours(rows, "id", "x", k, probes)
    near = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
    share = F.floor(F.lit(missing) / F.col("n")) + F.when(F.col("at") <= F.lit(missing) % F.col("n"), 1).otherwise(0)
    drawn = rows.withColumn("share", share).filter("share > 0").join(near, "id", "left") \
        .select("id", "x", "near", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share"))).alias("copy"))
    pick = F.pmod(F.xxhash64("id", "copy", F.lit(seed + 1)), F.greatest(F.size("near"), F.lit(1)).cast("long")).cast("int")
    drawn = drawn.select("id", "x", "copy", F.coalesce(F.get(F.col("near.neighbour"), pick), F.col("id")).alias("neighbour"),
                         _fraction("id", "copy", F.lit(seed + 2)).alias("u"))
    other = rows.select(F.col("id").alias("neighbour"), F.col("x").alias("y"))
    between = F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a))
    return drawn.join(other, "neighbour").select("id", "copy", "neighbour", "u", between.alias("vector"))


def oversample(df: DataFrame, id_col: str, vector_col: str, label: str = "label", k: int = 5, seed: int = 42, probes: int | None = None) -> DataFrame:
    """(vector, label, synthetic): all rows, and synthetic rows of the smaller class until both are equal."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(n) != 2:
        raise ValueError("label must have two classes")
    minority = min(n, key=lambda c: (n[c], c))
    base = df.select(F.col(vector_col).cast("array<double>").alias("vector"), label, F.lit(False).alias("synthetic"))
    missing = max(n.values()) - n[minority]
    if not missing:
        return base
    made = synthetic(df.filter(F.col(label) == minority), id_col, vector_col, missing, k, seed, probes)
    return base.unionByName(made.select("vector", F.lit(minority).cast(df.schema[label].dataType).alias(label), F.lit(True).alias("synthetic")))
