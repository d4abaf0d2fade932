import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lendlens.llm import token_files as tf
from lendlens.llm.common import shared_folder
from tests.llm.fixtures import awkward_docs, empty_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 10 ** 6), min_size=1, max_size=300), st.integers(9, 20))
@settings(max_examples=60, deadline=None)
def test_code_lengths_are_a_full_prefix_code(counts, limit):
    lengths = tf.code_lengths(np.array(counts), limit)
    assert lengths.max() <= limit
    total = sum(2.0 ** -int(n) for n in lengths)
    assert total == 1.0 if len(counts) > 1 else total == 0.5


def test_code_lengths_match_huffman_where_the_limit_is_loose():
    import heapq

    rng = np.random.default_rng(3)
    counts = rng.integers(1, 1000, 200)
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert int((tf.code_lengths(counts, 30) * counts).sum()) == cost
    with pytest.raises(ValueError):
        tf.code_lengths(counts, 7)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 900).astype("<u2")
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    code = tf.Code(symbols, tf.code_lengths(counts[symbols], 12))
    payload, steps = tf.pack(ids, code.encoder())
    assert (tf.unpack(payload, steps, n, code, code.table()) == ids).all()


def test_cached_encoding_equals_the_library():
    library, own = Tokenizer.from_file(PATH), tf.encoder(PATH)
    texts = ["it's I'LL don't '’s a", "<|endoftext|> x", "áe é\x1c b\x85c\xa0d e", "ÀÉß ŉ²½ªº x²", "", " \n\t ", "İstanbul ΑΣ ς", "!'s ''s 're", "日本語 text",
             "a_b-c 12 3.4", "e\u0301 combining", "x" * 3000]
    for t in texts * 2:
        assert own.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, own.width).tobytes(), t


def test_files_hold_every_document_in_order(spark):
    docs = awkward_docs(spark)
    path = shared_folder(spark, "t")
    tf.write_corpus(docs, path, PATH)
    got = sorted((r.start, r.id, r.n_tokens, bytes(r.ids)) for r in tf.read_token_files(spark, path).collect())
    library = Tokenizer.from_file(PATH)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in docs.collect()), key=lambda r: r[:2])
    assert [g[1] for g in got] == [i if known else None for known, i, _ in rows]
    want = sorted(zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for *_, t in rows)
    assert sorted(zlib.crc32(g[3]) for g in got) == want
    at = 0
    for start, _, n, ids in got:
        assert start == at and len(ids) == 4 * n
        at += n


def test_small_blocks_and_empty_tables(spark):
    path = shared_folder(spark, "t")
    tf.write_corpus(empty_docs(spark), path, PATH)
    assert tf.read_token_files(spark, path).collect() == []
    docs = awkward_docs(spark, 15, with_null_id=False)
    tokens = tf.staged(tf.tokenize(docs, PATH), "t")
    path = shared_folder(spark, "t")
    tf.write_token_files(tokens, path, tf.encoder(PATH).width, block_tokens=50)
    assert spark.read.parquet(f"{path}/blocks").count() > 10
    assert tf.read_token_files(spark, path).count() == docs.count()
