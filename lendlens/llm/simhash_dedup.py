"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints are 64-bit majority sketches of word shingles. Two fingerprints
link when at most ``radius`` bits differ. The hash tables are a covering
family (Pagh, 2016): bit i gets a non-zero vector m(i) of radius + 1 bits, and
table v (every non-zero vector) keeps the bits with <m(i), v> odd. For any
``radius`` differing bits there is a v orthogonal to all their vectors, so
that table keeps none of them: every pair within the radius meets in a table,
with no chance involved, and every table keeps about half of the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import components, joined, staged

BITS = 64
SEED = 42


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 bit masks, as signed 64-bit integers."""
    n = 2 ** (radius + 1) - 1
    vector = [i % n + 1 for i in range(bits)]  # the structured map from bits to vectors
    masks = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit fingerprint of one whole text (null counts as empty)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):  # long texts in pieces: the bit matrix stays small
        cut = slice(at, min(at + (1 << 16), n))
        spans = zip(starts[cut].tolist(), ends[k - 1:][cut].tolist(), strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                 carried: dict[str, Column] | None = None) -> DataFrame:
    """(id, fp, and the ``carried`` columns): the fingerprint of every row's whole text as a signed long."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["id", "fp", *names])

    names = list(carried or {})
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(n) for n, c in (carried or {}).items()])
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    return rows.mapInArrow(sketch, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}, fp long", *kinds]))


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Links that join what is joined within one bucket: breadth-first search over
    the fingerprints not reached yet, so that dense groups cost little and each
    fingerprint is linked once."""
    links, left = [], fps
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hit = left[near]
                links.append((x, hit))
                frontier.extend(hit)
                left = left[~near]
    return links


def _bucket_links(buckets: DataFrame, radius: int, block: int | None) -> DataFrame:
    """Link rows (a, b, chunk null) of buckets (key, fp). Rows arrive sorted by
    key, so a task holds one bucket at a time. With ``block``, a longer bucket
    is not searched here: its rows leave as (key, fp, chunk of ``block`` rows)."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, chunk, over = None, [], 0, False

        def rows(a, b, c=None):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                               pa.array([c] * len(a), pa.int64())], names=["a", "b", "chunk"])

        def close():
            fps = np.concatenate(held) if held else np.zeros(0, np.uint64)
            if over:
                return [rows(np.full(len(fps), key), fps.view(np.int64), chunk)] if len(fps) else []
            found = spanning_links(np.unique(fps), radius) if len(fps) > 1 else []
            if not found:
                return []
            a = np.repeat(np.array([x for x, _ in found], np.uint64), [len(h) for _, h in found])
            return [rows(a.view(np.int64), np.concatenate([h for _, h in found]).view(np.int64))]

        for batch in batches:
            keys = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            size = np.diff(cuts)
            # pairs inside the batch, all at once
            inner = np.ones(len(size), bool)
            inner[[0, -1]] = False  # these may go on in another batch
            two = cuts[:-1][(size == 2) & inner]
            x, y = fps[two], fps[two + 1]
            near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
            if near.any():
                yield rows(x[near].view(np.int64), y[near].view(np.int64))
            for i in np.flatnonzero((size > 2) | ~inner).tolist():
                k, run = int(keys[cuts[i]]), fps[cuts[i]:cuts[i + 1]]
                if k != key:
                    if key is not None:
                        yield from close()
                    key, held, chunk, over = k, [], 0, False
                for s in range(0, len(run), block or len(run)):
                    held.append(run[s:s + (block or len(run))])
                    if block and sum(map(len, held)) >= block:
                        full, held = np.concatenate(held), []
                        if over or len(full) > block:
                            over = True
                            yield rows(np.full(block, key), full[:block].view(np.int64), chunk)
                            chunk += 1
                            full = full[block:]
                        held = [full]
        if key is not None:
            yield from close()

    return buckets.mapInArrow(search, "a long, b long, chunk long")


def _by_key(df: DataFrame) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key")


def fingerprint_links(fps: DataFrame, radius: int = 4, block: int = 16384) -> DataFrame:
    """(a, b): links that join all fingerprints within the radius into their components.

    ``fps`` has one column fp of distinct longs. One shuffle deals each
    fingerprint to its bucket in every table. A bucket of more than ``block``
    fingerprints is split into chunks, and every pair of its chunks is searched
    as a bucket of its own: exact for any size, with bounded memory.
    """
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long")))
                       for t, m in enumerate(covering_masks(radius))])
    found = staged(_bucket_links(_by_key(fps.select(F.explode(tables).alias("key"), "fp")), radius, block), "links")
    links = found.filter("chunk IS NULL").select("a", "b")
    parts = found.filter("chunk IS NOT NULL").select(F.col("a").alias("key"), F.col("b").alias("fp"), "chunk")
    if parts.head(1):
        last = parts.groupBy("key").agg(F.max("chunk").alias("last"))
        pairs = parts.join(last, "key").select("key", "fp", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other")) \
            .select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "fp")
        links = links.unionAll(_bucket_links(_by_key(pairs), radius, None).select("a", "b"))
    return links


def roots(fps: DataFrame, least: Column, radius: int = 4, block: int = 16384) -> DataFrame:
    """(fp, rows, least, root): every fingerprint with its number of rows, its smallest ``least`` and the
    fingerprint that stands for its component."""
    first = staged(fps.groupBy("fp").agg(F.count("*").alias("rows"), F.min(least).alias("least")), "distinct-fingerprints")
    graph = components(fingerprint_links(first.select("fp"), radius, block))
    return first.join(graph, first["fp"] == graph["node"], "left") \
        .select("fp", "rows", "least", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4, block: int = 16384) -> DataFrame:
    """(id, fp, component): every row with the smallest id that its links reach.

    Null and blank texts have fingerprint zero and link like any other. Rows
    with equal ids stay separate rows. A null id takes part and counts as the
    largest; a component of null ids only has a null component. An empty table
    gives an empty result; other columns are not read.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    root = roots(fps, F.col("id"), radius, block)
    least = root.groupBy("root").agg(F.min("least").alias("component"))
    named = root.join(least, "root").select("fp", "rows", "component")
    return joined(fps, named, ["fp"], fps.count()).select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
               radius: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each component: the smallest id, null ids last, of rows with
    that id the smallest by a hash of the text. Of rows equal in id and text any one stays.

    Null and blank texts are copies of each other; an empty table gives an empty one; columns of any names keep their values."""
    fps = staged(fingerprints(docs, id_col, text_col, shingle, {"th": F.xxhash64(text_col)}), "fingerprints")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    found = roots(fps, place, radius).groupBy("root").agg(F.min("least").alias("least")) \
        .select(F.struct("least.id", "least.th").alias("key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("key"))
    kept = rows.join(found, "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
