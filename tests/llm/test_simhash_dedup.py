import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from lendlens.llm import simhash_dedup as sd
from lendlens.llm.common import components
from tests.llm.fixtures import awkward_docs, empty_docs, sentence


def plain(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(k, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_close_pair_meets_in_a_table(radius):
    masks = [m % (1 << 64) for m in sd.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        d = sum(1 << b for b in bits)
        assert any(not d & m for m in masks)


def test_every_pair_within_four_bits_meets():
    masks = [m % (1 << 64) for m in sd.covering_masks(4)]
    rng = random.Random(1)
    for _ in range(20000):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not d & m for m in masks)


def groups(ids, fps, radius):
    """Smallest reachable id of each row, nulls last."""
    n, out = len(ids), [None] * len(ids)
    order = sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0))
    seen = set()
    for s in order:
        if s in seen:
            continue
        todo = [s]
        seen.add(s)
        while todo:
            a = todo.pop()
            out[a] = ids[s]
            for b in range(n):
                if b not in seen and (fps[a] ^ fps[b]).bit_count() <= radius:
                    seen.add(b)
                    todo.append(b)
    return out


def test_awkward_documents(spark):
    docs = awkward_docs(spark)
    rows = docs.collect()
    fps = [plain(r.text) for r in rows]
    want = sorted(zip([str(r.doc_id) for r in rows], fps, groups([r.doc_id for r in rows], fps, 4)), key=str)
    got = sd.near_duplicates(docs).collect()
    assert sorted([(str(r.id), r.fp % (1 << 64), r.component) for r in got], key=str) == want
    kept = sd.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want if c is not None})
    assert sd.near_duplicates(empty_docs(spark)).collect() == [] and sd.keep_first(empty_docs(spark)).collect() == []


def test_rows_without_an_id_or_with_one_id_keep_one_of_each_component(spark):
    rng = random.Random(8)
    a, b, c, d, e = [sentence(rng, 30) for _ in range(5)]
    rows = [(None, a), (None, a), (None, b), (None, c), (1, c), (2, d), (2, e), (3, e)]
    got = [(r.doc_id, r.text) for r in sd.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (1, c), (2, d), (2, e)], key=str)


@pytest.mark.parametrize("block", [16384, 8])
def test_links_of_fingerprints_in_dense_and_sparse_buckets(spark, block):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(100)} | {centre ^ (0b11111111 << s) for s in range(0, 50, 7)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = sd.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, block).collect()
    assert all((int(r.a) ^ int(r.b)) % (1 << 64) != 0 and ((int(r.a) ^ int(r.b)) % (1 << 64)).bit_count() <= 4 for r in found)
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[root(r.a)] = root(r.b)
    want = groups(list(range(len(fps))), fps, 4)
    own = {}
    assert [own.setdefault(root(x), i) for i, x in enumerate(signed)] == want


def test_long_texts_are_counted_whole():
    text = " ".join(f"w{i * i % 9973}" for i in range(70000))
    assert sd.fingerprint(text) == plain(text)


def test_components_of_chains_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
