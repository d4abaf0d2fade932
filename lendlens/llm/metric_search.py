"""Exact top-k inner-product search with an M-tree of paged metric nodes.

Inner products become distances by the usual lift: a stored vector x gets one
more coordinate sqrt(M^2 - |x|^2), a query gets 0, so that
d(q, x)^2 = |q|^2 + M^2 - 2 <q, x> and the largest products are the nearest
neighbours. Stored vectors are dealt to their nearest pivots (a bounded
sample), sorted, and cut into pages; some pages make a node. Nodes, pages and
entries keep a covering radius and the distance to their parent's routing
object, so the triangle inequality rules most of them out without a distance.

The search is best-first over that tree. Queries meet the index in blocks: a
unit of work is a bounded group of nodes and a bounded group of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import hash_sample, smallest_rows, staged

PAGE = 128
FANOUT = 16
PIVOTS = 64
NODES_A_UNIT = 16
QUERIES_A_UNIT = 2048


def usable(vector: str | Column) -> Column:
    """Vectors that are not null and hold finite components only."""
    v = F.col(vector) if isinstance(vector, str) else vector
    inf = F.lit(float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))


def quantised(vector: str, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def lift(x: np.ndarray, m2: float) -> np.ndarray:
    """The extra coordinate of stored vectors."""
    return np.sqrt(np.maximum(0.0, m2 - np.einsum("ij,ij->i", x, x)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def build_index(entries: DataFrame, width: int, m2: float, pivots: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> DataFrame:
    """Node rows from distinct ``entries`` (vec: array of ``width`` longs, ids: array of longs)."""
    px = pivots.astype(np.float64)
    pz, pn = lift(px, m2), np.einsum("ij,ij->i", px, px)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), width).astype(np.float64)
            z = lift(x, m2)
            d2 = np.einsum("ij,ij->i", x, x)[:, None] + pn - 2 * x @ px.T + (z[:, None] - pz) ** 2
            near = np.argsort(d2, axis=1, kind="stable")[:, :2]
            dist = np.sqrt(np.maximum(0.0, np.take_along_axis(d2, near[:, :1], 1)))[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near[:, 0].astype(np.int32)), pa.array(near[:, -1].astype(np.int32)), pa.array(dist)],
                                             names=["vec", "ids", "pivot", "second", "dist"])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, pivot = [], 0, None

        def close():
            vec, ids = np.concatenate([h[0] for h in held]), [i for h in held for i in h[1]]
            return _node_row(vec, ids, pivot, px, pz, m2, page)

        for b in batches:
            vec, ids, own = _matrix(b.column(0), width), b.column(1).to_pylist(), b.column(2).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)]))
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if held and (own[s] != pivot):
                    yield close()
                    held, n = [], 0
                pivot = int(own[s])
                while s < e:
                    take = min(e - s, page * fanout - n)
                    held.append((vec[s:s + take], ids[s:s + take]))
                    n, s = n + take, s + take
                    if n == page * fanout:
                        yield close()
                        held, n = [], 0
        if held:
            yield close()

    dealt = entries.select("vec", "ids").mapInArrow(deal, "vec array<bigint>, ids array<bigint>, pivot int, second int, dist double")
    order = ["pivot", "second", "dist"]
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order, "ids").mapInArrow(nodes, NODE_SCHEMA)


NODE_SCHEMA = ("first long, n int, pivot int, vecs binary, ids binary, n_ids binary, center int, radius double, to_pivot double, "
               "page_start binary, page_center binary, page_radius binary, page_to_node binary, entry_to_page binary")


def _node_row(vec, ids, pivot, px, pz, m2, page):
    x = vec.astype(np.float64)
    z = lift(x, m2)

    def medoid(rows):
        mean = x[rows].mean(0)
        return int(rows[np.argmin(((x[rows] - mean) ** 2).sum(1))])

    def dist(rows, c):
        return np.sqrt(((x[rows] - x[c]) ** 2).sum(1) + (z[rows] - z[c]) ** 2)

    every = np.arange(len(x))
    center = medoid(every)
    starts = np.arange(0, len(x), page, dtype=np.int32)
    pages = [every[s:s + page] for s in starts]
    centers = np.array([medoid(p) for p in pages], np.int32)
    entry = np.concatenate([dist(p, c) for p, c in zip(pages, centers, strict=True)])
    radius = np.array([entry[p].max() for p in pages])
    most = max(map(len, ids))
    padded = np.zeros((len(ids), most), np.int64)
    for i, own in enumerate(ids):
        padded[i, :len(own)] = own
    to_pivot = float(np.sqrt(((x[center] - px[pivot]) ** 2).sum() + (z[center] - pz[pivot]) ** 2))
    cells = [int(padded[0, 0]), len(x), pivot, vec.tobytes(), padded.tobytes(), np.array([len(i) for i in ids], np.int32).tobytes(), center,
             float(dist(every, center).max()), to_pivot, starts.tobytes(), centers.tobytes(), radius.tobytes(), dist(centers, center).tobytes(),
             entry.tobytes()]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)],
                                      names=[f.split(" ")[0] for f in NODE_SCHEMA.split(", ")])


class Tree:
    """The nodes of one unit, for best-first search."""

    def __init__(self, rows: list[dict], width: int, m2: float, pivots: np.ndarray):
        self.m2, self.exact = m2, m2 < 2.0 ** 53  # then every partial sum of a product is exact in a double
        self.px = pivots.astype(np.float64)
        self.pz = lift(self.px, m2)
        self.nodes = []
        for r in rows:
            vec = np.frombuffer(r["vecs"], np.int64).reshape(-1, width)
            x = vec.astype(np.float64)
            self.nodes.append({
                "x": x if self.exact else vec, "f": x, "z": lift(x, m2), "ids": np.frombuffer(r["ids"], np.int64).reshape(len(x), -1),
                "n_ids": np.frombuffer(r["n_ids"], np.int32), "start": np.append(np.frombuffer(r["page_start"], np.int32), len(x)),
                "center": np.frombuffer(r["page_center"], np.int32), "radius": np.frombuffer(r["page_radius"]),
                "to_node": np.frombuffer(r["page_to_node"]), "entry": np.frombuffer(r["entry_to_page"])})
        self.pivot = np.array([r["pivot"] for r in rows])
        self.center = np.array([r["center"] for r in rows])
        self.radius = np.array([r["radius"] for r in rows])
        self.to_pivot = np.array([r["to_pivot"] for r in rows])
        self.computed = 0

    def search(self, q: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
        """At most k (score, ids) by descending score, ties by the smallest id."""
        f = q.astype(np.float64)
        own = q if not self.exact else f
        q2 = float(f @ f)
        slack = 1e-9 * (1.0 + np.sqrt(q2) + np.sqrt(self.m2)) + 1e-12 * (q2 + self.m2)
        to_p = np.sqrt(((self.px - f) ** 2).sum(1) + self.pz ** 2)
        seen = self.px @ f
        best: list[tuple[int, int, np.ndarray]] = []  # (-score, smallest id, ids)
        # the pivots are k or more different vectors of the index: no answer scores less than the k-th of them
        least = np.sort(seen)[-k] - slack if len(seen) >= k else -np.inf

        def reach() -> float:
            low = max(least, -best[-1][0]) if len(best) == k else least
            return np.sqrt(max(0.0, q2 + self.m2 - 2 * low)) + slack if low > -np.inf else np.inf

        bound = np.maximum(0.0, np.abs(to_p[self.pivot] - self.to_pivot) - self.radius)
        heap = [(float(b), 0, i, 0, 0.0) for i, b in enumerate(bound)]
        heapq.heapify(heap)
        limit = reach()
        while heap:
            low, kind, i, p, d = heapq.heappop(heap)
            if low > limit:
                break
            node = self.nodes[i]
            if kind in (0, 2):  # a bound from stored distances only: now compute the distance to the routing object
                c = self.center[i] if kind == 0 else node["center"][p]
                d = float(np.sqrt(((node["f"][c] - f) ** 2).sum() + node["z"][c] ** 2))
                self.computed += 1
                r = self.radius[i] if kind == 0 else node["radius"][p]
                heapq.heappush(heap, (max(low, d - r), kind + 1, i, p, d))
            elif kind == 1:
                lows = np.maximum(low, np.abs(d - node["to_node"]) - node["radius"])
                for j in np.flatnonzero(lows <= limit).tolist():
                    heapq.heappush(heap, (float(lows[j]), 2, i, j, 0.0))
            else:
                rows = np.arange(node["start"][p], node["start"][p + 1])
                rows = rows[np.abs(d - node["entry"][rows]) <= limit]
                if not len(rows):
                    continue
                scores = node["x"][rows] @ own
                self.computed += len(rows)
                floor = max(least, -best[-1][0] if len(best) == k else -np.inf)
                hit = np.flatnonzero(scores >= floor)
                for j in hit[np.argsort(-scores[hit], kind="stable")].tolist():
                    at = rows[j]
                    item = (-int(scores[j]), int(node["ids"][at, 0]), node["ids"][at, :node["n_ids"][at]])
                    if len(best) == k and item[:2] >= best[-1][:2]:
                        if item[0] > best[-1][0]:
                            break
                        continue
                    best.append(item)
                    best.sort(key=lambda t: t[:2])
                    del best[k:]
                limit = reach()
        return [(-s, ids) for s, _, ids in best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vec", page: int = PAGE,
          fanout: int = FANOUT, n_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best integer inner products of each query row.

    Both tables hold (id, array of integers). A query meets every row but those
    of its own id; ties go to the smaller id. Rows with a null id or a null
    vector, or a vector holding nulls, take no part; shorter vectors count as
    filled up with zeros. Equal vectors are stored once, with their k + 1
    smallest ids, which is all that k answers can need. Repeated ids count
    once for each different vector. Empty tables give an empty result; other columns are not read.
    ``n_pivots`` bounds the sample that reaches the driver.
    """
    spark = vectors.sparkSession

    def clean(df):
        v = F.col(vector_col).cast("array<bigint>")
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL)")

    answer = "query_id long, rank int, vec_id long, score long"
    size = clean(vectors).agg(F.max(F.size("vec")).alias("w"), F.count("*").alias("n")).first()
    size_q = clean(queries).agg(F.max(F.size("vec")).alias("w"), F.count("*").alias("n")).first()
    if not size["n"] or not size_q["n"]:
        return spark.createDataFrame([], answer)
    width = max(1, size["w"], size_q["w"])

    def padded(df):
        return clean(df).select("id", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec"))).alias("vec"))

    firsts = smallest_rows(padded(vectors).distinct(), ["vec"], ["id"], k + 1)
    entries = staged(firsts.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    m2 = float(entries.agg(F.max(norm)).first()[0])
    pivots = np.array([r["vec"] for r in hash_sample(entries.select("vec"), n_pivots)], np.int64).reshape(-1, width)
    nodes = staged(build_index(entries, width, m2, pivots, page, fanout), "nodes")

    asked = staged(padded(queries).distinct(), "queries")
    one = staged(asked.groupBy("vec").agg(F.min("id").alias("key")), "distinct-queries")
    n_nodes, n_queries = nodes.count(), one.count()
    groups_n, groups_q = -(-n_nodes // NODES_A_UNIT), -(-n_queries // QUERIES_A_UNIT)
    left = nodes.withColumn("h", F.pmod(F.xxhash64("first"), F.lit(groups_n))) \
        .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups_q - 1)))) \
        .withColumn("unit", F.col("g") * groups_n + F.col("h")).drop("g", "h")
    right = one.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups_q))) \
        .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups_n - 1)))) \
        .withColumn("unit", F.col("g") * groups_n + F.col("h")).select("key", "vec", "unit")

    def unit(tree: pa.Table, ask: pa.Table) -> pa.Table:
        keys, scores, ids = [], [], []
        if tree.num_rows and ask.num_rows:
            index = Tree(tree.to_pylist(), width, m2, pivots)
            asked_vecs = _matrix(ask["vec"].combine_chunks(), width)
            for key, q in zip(ask["key"].to_pylist(), asked_vecs, strict=True):
                for score, own in index.search(q, k + 1):
                    keys.append(key)
                    scores.append(score)
                    ids.append(own.tolist())
        return pa.table({"key": pa.array(keys, pa.int64()), "score": pa.array(scores, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    found = left.groupBy("unit").cogroup(right.groupBy("unit")).applyInArrow(unit, "key long, score long, ids array<bigint>")
    best = smallest_rows(found, ["key"], [F.desc("score"), F.col("ids")[0]], k + 1).select("key", "score", F.explode("ids").alias("vec_id"))
    rows = asked.join(one, "vec").select(F.col("id").alias("query_id"), "key").join(best, "key").filter("query_id <> vec_id")
    return smallest_rows(rows.select("query_id", "vec_id", "score"), ["query_id"], [F.desc("score"), "vec_id"], k) \
        .select("query_id", "rank", "vec_id", "score")
