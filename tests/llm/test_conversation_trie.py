import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lendlens.llm import catalog, common
from lendlens.llm import conversation_trie as ct
from tests.conftest import SF

ROW = "conv_id long, turn long, role string, text string"


def order(rows):
    """{conv_id: [(role, text)]} in order of turns."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            out[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [v[1:] for v in sorted(turns)] for c, turns in out.items()}


def trie(convs):
    """The rows of the trie of {conv_id: turns}, from a plain dictionary of prefixes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
    out = Counter()
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(node))))
        out[min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.collect())


def made(seed, n=60, longest=30):
    rng = random.Random(seed)
    rows, known = [], [[]]
    for c in range(n):
        turns = list(rng.choice(known))[: rng.randrange(longest)]
        turns += [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é" * 3, "x y", ""])) for _ in range(rng.randrange(4))]
        known.append(turns)
        rows += [(c, k, r, x) for k, (r, x) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("block,chunk,crowd", [(8, 4096, 4096), (4, 8, 4096), (1, 1, 4096), (3, 6, 1)])
def test_trie_equals_plain_dictionary(spark, block, chunk, crowd, monkeypatch):
    monkeypatch.setattr(common, "CROWD", crowd)
    rows = made(block)
    extra = [(100, None, None, None), (100, None, "user", "a"), (100, 1, "user", None), (101, 2, "b", "b"), (101, 2, "a", "c"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows + extra, ROW).withColumns({"pos": F.lit(1), "depth": F.lit("d"), "p1": F.lit(2)})
    turns = ct.numbered(df).withColumnRenamed("k", "pos")
    convs = df.filter("conv_id IS NOT NULL").select("conv_id").union(spark.createDataFrame([(500,), (501,)], "conv_id long")).distinct()
    want = trie(order(rows + extra) | {500: [], 501: []})
    assert got(ct.prefix_trie(turns, convs, block, chunk)) == want


def test_long_lists_of_ids_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIECE", 40)
    rows = [(c, 0, "user", "hello") for c in range(300)] + [(-7, 0, "user", "hello"), (-8, 0, "user", "other")]
    df = spark.createDataFrame(rows, ROW)
    turns = ct.numbered(df).withColumnRenamed("k", "pos")
    assert got(ct.prefix_trie(turns, df.select("conv_id").distinct())) == trie(order(rows))
    none = spark.createDataFrame([], ROW)
    assert ct.prefix_trie(ct.numbered(none).withColumnRenamed("k", "pos"), none.select("conv_id")).collect() == []


def rebuilt(rows):
    turns = order(rows)
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def test_query_equals_plain_dictionary(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = catalog.QUERIES["op11_conversation_trie"](spark, SF)
    assert got(df) == trie(rebuilt(rows))
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]


def test_rebuilding_awkward_conversations(spark, tmp_path):
    rows = made(5, 40) + [(41, None, None, "n"), (43, 0, "user", "x")] + [(c, t, "user", f"{c % 2}") for c in range(60, 90, 3) for t in range(c % 11)]
    rows += [(None, 0, "user", "x"), (92, 1, "user", "only one")]
    spark.createDataFrame(rows, ROW).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(catalog.QUERIES["op11_conversation_trie"](spark, str(tmp_path))) == trie(rebuilt(rows))
