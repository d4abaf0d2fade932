"""Conversation prefix trie by fixed-length block hashing.

A node is a sequence of turns with which at least one conversation starts; the
root is the empty one. Every conversation gets the digest of each of its
prefixes: the sum of a 128-bit hash of (position, role, text) over its turns,
added up by chunks, so that a conversation of any length is spread over many tasks.

Nodes are found in two steps. First conversations are grouped by whole blocks of
``block`` turns: one row per block says which prefix it starts from and which it
leads to, and equal rows are merged and counted before the shuffle. Only where
several different blocks follow one prefix do siblings diverge inside; there the
merged blocks, not the conversations, are refined turn by turn. A block without a
rival is a chain of nodes with the block's own members.

What holds for a whole subtree is summed from its leaves: each leaf sends its
path, one row per turn, with the saving of a node on the path of one leaf alone, the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.common import joined, staged
from lendlens.operators.rank import ranked

BLOCK = 8
CHUNK = 4096  # turns whose running sums one task adds up; a multiple of BLOCK
BIG = "decimal(38,0)"
PIECE = 1 << 16  # characters of a piece of a long list of ids
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, role, text): the turns of every conversation, numbered from 1.

    Order is by turn, null first, then by role and text; null roles and texts are
    empty; rows without a conversation id belong to none; repeated rows stay."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return ranked(turns, ["conv_id"], ["turn", "role", "text"], "k").select("conv_id", "k", "role", "text")


def prefixes(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(conv_id, n, pos, j, p1, p2, q1, q2, b1, b2, bytes): a row per turn of every conversation, and one
    for the empty prefix (pos 0). p is the digest up to the turn, q up to the one before,
    b at the start of the turn's block j."""
    hashes = turns.select("conv_id", "pos", F.octet_length("text").cast("long").alias("bytes"), F.floor((F.col("pos") - 1) / chunk).alias("chunk"),
                          F.xxhash64("pos", "role", "text").cast(BIG).alias("h1"), F.xxhash64("text", "pos", "role").cast(BIG).alias("h2"))
    hashes = staged(hashes, "turn-hashes")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashes.groupBy("conv_id", "chunk").agg(F.sum("h1").cast(BIG).alias("s1"), F.sum("h2").cast(BIG).alias("s2"), F.count("*").alias("size"))
    sums = sums.withColumns({f"c{i}": F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).cast(BIG) for i in (1, 2)}) \
        .withColumn("n", F.sum("size").over(Window.partitionBy("conv_id"))).select("conv_id", "chunk", "c1", "c2", "n")
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = hashes.withColumns({f"r{i}": F.sum(f"h{i}").over(so_far).cast(BIG) for i in (1, 2)}).join(sums, ["conv_id", "chunk"])

    def digest(i, minus=False):
        total = F.col(f"c{i}") + F.col(f"r{i}") - (F.col(f"h{i}") if minus else F.lit(0).cast(BIG))
        return F.when(F.col("pos") == 1, 0).otherwise(F.xxhash64(total.cast(BIG), F.lit(i))) if minus else F.xxhash64(total.cast(BIG), F.lit(i))

    rows = placed.select("conv_id", "n", "pos", "chunk", F.floor((F.col("pos") - 1) / block).alias("j"), digest(1).alias("p1"), digest(2).alias("p2"),
                         digest(1, True).alias("q1"), digest(2, True).alias("q2"), "bytes")
    start = Window.partitionBy("conv_id", "chunk", "j").orderBy("pos")
    rows = rows.withColumns({"b1": F.first("q1").over(start), "b2": F.first("q2").over(start)}).drop("chunk")
    zero = {c: F.lit(0).cast("long") for c in ("pos", "p1", "p2", "q1", "q2", "b1", "b2", "bytes")}
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    empty = convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")) \
        .withColumns(zero | {"j": F.lit(-1).cast("long")})
    return rows.unionByName(empty)


def nodes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(depth, p1, p2, q1, q2, bytes, n_convs, conv_id): every node with its members' number and the smallest."""
    ends = rows.filter((F.col("pos") % block == 0) | (F.col("pos") == F.col("n")))
    size = F.struct((F.col("pos") - F.greatest(F.col("j"), F.lit(0)) * block).alias("size"), "p1", "p2").alias("to")
    blocks = staged(ends.groupBy("j", "b1", "b2", size).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("rep")), "blocks")
    # one block follows the prefix alone: its turns need no further look
    alone = blocks.groupBy("j", "b1", "b2").agg(F.count("*").alias("rivals"), F.max("rep").alias("rep"), F.max("n_convs").alias("n_convs")) \
        .filter("rivals = 1").select(F.col("rep").alias("conv_id"), "j", "n_convs")
    alone = staged(alone, "lone-blocks")
    split = blocks.select(F.col("rep").alias("conv_id"), "j", "n_convs").join(alone.select("conv_id", "j"), ["conv_id", "j"], "left_anti")
    inner = rows.select("conv_id", "j", F.col("pos").alias("depth"), "p1", "p2", "q1", "q2", "bytes")
    chains = inner.join(alone, ["conv_id", "j"]).select("depth", "p1", "p2", "q1", "q2", "bytes", "n_convs", "conv_id")
    refined = inner.join(split, ["conv_id", "j"]).groupBy("depth", "p1", "p2").agg(
        F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("bytes").alias("bytes"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return chains.unionByName(refined)


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): the hash of each node's ids, ascending and joined by commas.

    Ids are sorted and joined by ranges of (node, id) first, so that only pieces of
    text meet in the task that takes a node's hash, in order and one at a time."""
    key = ["depth", "p1", "p2"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, None, [], 0
        for b in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (row[:3] != node or size > PIECE):
                    out.append((*node, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    node, first = row[:3], row[3]
                held.append(str(row[3]))
                size += len(held[-1]) + 1
            yield _batch(out, [*key, "first", "piece"])
        yield _batch([(*node, first, ",".join(held))] if held else [], [*key, "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:3] != node:
                    if state:
                        out.append((*node, state.hexdigest()))
                    node, state = row[:3], hashlib.sha256(row[4].encode())
                else:
                    state.update(b"," + row[4].encode())
            yield _batch(out, [*key, "ends_sha256"])
        yield _batch([(*node, state.hexdigest())] if state else [], [*key, "ends_sha256"])

    rows = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id") \
        .mapInArrow(pieces, "depth long, p1 long, p2 long, first long, piece string")
    return rows.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n in ("piece", "ends_sha256") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node.

    ``turns`` holds (conv_id, pos, role, text), positions of a conversation from 1 on
    without gaps, no nulls; ``convs`` every conv_id once, also those without a turn. Names are those of
    the registered query: ``conv_id`` is the node's smallest member, ``saved_tokens`` the bytes of
    last turns that its subtree's other members need not store. Other columns are not read. No
    conversation, no node: an empty table gives an empty result.
    """
    if chunk % block:
        raise ValueError("a chunk must hold whole blocks")
    key = ["depth", "p1", "p2"]
    rows = staged(prefixes(turns.select("conv_id", "pos", "role", "text"), convs.select("conv_id"), chunk, block), "prefixes")
    tree = staged(nodes(rows, block), "nodes")
    total = tree.count()
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    below = staged(tree.filter("depth > 0").select(*up).groupBy(*key).agg(F.count("*").alias("rows")), "children")
    # the smallest member of each end that no other conversation continues
    ends = rows.filter("pos = n").select(F.col("pos").alias("depth"), "p1", "p2", "conv_id")
    leaves = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id")).join(below, key, "left_anti").select("conv_id")
    paths = staged(rows.join(leaves, "conv_id", "left_semi").select("conv_id", "n", F.col("pos").alias("depth"), "p1", "p2"), "paths")
    first = paths.groupBy(*key).agg(F.min("conv_id").alias("leaf"), F.count("*").alias("n_leaves"))
    tree = staged(tree.join(first, key), "counted-nodes")
    saved = tree.select(F.col("leaf").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    steps = paths.join(saved, ["conv_id", "depth"], "left").withColumns({
        "saved": F.coalesce("saved", F.lit(0)).cast("long"), "chunk": F.floor(F.col("depth") / chunk)})
    steps = staged(steps, "savings")
    later = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    after = steps.groupBy("conv_id", "chunk").agg(F.sum("saved").alias("s")).withColumn("after", F.coalesce(F.sum("s").over(later), F.lit(0)))
    from_here = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.withColumn("own", F.sum("saved").over(from_here)).join(after.select("conv_id", "chunk", "after"), ["conv_id", "chunk"]) \
        .groupBy(*key).agg(F.sum(F.col("own") + F.col("after")).alias("saved_tokens"))
    # parents by their children's prefix; a parent of many children is broadcast
    parents = tree.join(below, key).select(F.col("depth").alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                                           F.col("conv_id").alias("parent_conv_id"), "rows")
    child = tree.filter("depth > 0").select("depth", "p1", "p2", "q1", "q2", (F.col("depth") - 1).alias("d"))
    named = joined(child, parents, ["d", "q1", "q2"], total).select(*key, "parent_conv_id")
    return tree.join(named, key, "left").join(below, key, "left").join(sums, key).join(id_digests(ends), key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("rows", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
