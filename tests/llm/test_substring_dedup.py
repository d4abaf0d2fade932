import random
from collections import Counter

import numpy as np
import pytest

from lendlens.llm import catalog, common
from lendlens.llm import substring_dedup as sd
from tests.conftest import SF
from tests.llm.fixtures import awkward_docs, empty_docs


def plain(texts, window):
    """(n_words, n_removed, kept) of every text by counting all windows."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def result(df):
    return Counter((r.id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def passages(n, seed, words=6, vocabulary=400):
    rng = random.Random(seed)

    def sentence(k):
        return [f"w{rng.randrange(vocabulary)}" for _ in range(k)]

    shared = [sentence(rng.randrange(5, 40)) for _ in range(words)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else sentence(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 8))]
        out.append(" ".join(w for p in parts for w in p))
    return out


@pytest.mark.parametrize("window", [3, 8, 35])
@pytest.mark.parametrize("kind", ["random", "few words", "periodic"])
def test_search_finds_every_repeated_window(window, kind):
    rng = random.Random(window)
    texts = []
    for _ in range(60):
        n = rng.randrange(window, 3 * window + 20)
        if kind == "random":
            texts.append([f"w{rng.randrange(30)}" for _ in range(n)])
        elif kind == "few words":
            texts.append([rng.choice("ab") for _ in range(n)])
        else:
            texts.append((list("abcab")[: rng.randrange(1, 6)] * n)[:n])
    texts += [texts[0][:], texts[1][:-1], texts[2][1:] + ["z"], texts[3][: window]]
    texts = [list(t) for t in sorted({tuple(t) for t in texts})]
    weights = np.array([rng.choice([1, 1, 1, 2]) for _ in texts])
    got = sd.search([[w.encode() for w in t] for t in texts], weights, window)
    seen = Counter()
    for t, k in zip(texts, weights.tolist(), strict=True):
        for i in range(len(t) - window + 1):
            seen[tuple(t[i:i + window])] += k
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == [i for i in range(len(t) - window + 1) if seen[tuple(t[i:i + window])] > 1]


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (64, 3), (1000, 37), (4096, 1)):
        symbols = rng.integers(0, top + 1, n)
        m = sd.WaveletMatrix(symbols, top)
        for c in range(top + 1):
            places = rng.integers(0, n + 1, 20)
            base = m.move(np.array([c]), np.array([0]))
            got = m.move(np.full(20, c), places) - base
            assert got.tolist() == [(symbols[:p] == c).sum() for p in places]


@pytest.mark.parametrize("crowd,shard_bytes", [(4096, 3 << 20), (4096, 2000), (2, 2000)])
def test_documents_equal_plain_counting(spark, crowd, shard_bytes, monkeypatch):
    if crowd == 2:
        monkeypatch.setattr(common, "CROWD", 2)  # the joins with a crowded key too
    texts = passages(150, 1) + ["same words again " * 40, "a " * 300, "a " * 33, "a " * 35, "a " * 36 + "b"] + passages(20, 2, vocabulary=3)
    texts += texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window, gram in ((35, 16), (8, 4), (16, 16)):
        got = result(sd.drop_repeated(df, window, gram, shard_bytes, crowd))
        assert got == Counter((i, *r) for i, r in enumerate(plain(texts, window)))


def test_awkward_documents(spark):
    docs = awkward_docs(spark)
    rows = docs.collect()
    want = Counter((r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows], 35), strict=True))
    assert result(sd.drop_repeated(docs)) == want
    assert result(sd.drop_repeated(docs.withColumnsRenamed({"line": "_id", "key": "_th"}))) == want
    assert sd.drop_repeated(empty_docs(spark)).collect() == []
    assert result(sd.drop_repeated(docs.filter("text IS NULL"))) == Counter({k: n for k, n in want.items() if k[0] in (42, None) and k[1] == 0})


def test_query_equals_its_contract(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {(d.doc_id, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in zip(docs, plain([d.text for d in docs], 35), strict=True)}
    got = catalog.QUERIES["op12_fm_substring_dedup"](spark, SF)
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sum(w[2] > 0 for w in want) > 3
