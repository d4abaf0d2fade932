import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lendlens.llm import catalog
from lendlens.llm import periodic_runs as pr
from tests.conftest import SF
from tests.llm.fixtures import awkward_docs, empty_docs


def plain(words, least=12):
    """All runs by comparing every pair of places."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items() if e - s >= least)


def check(texts, least=2):
    got = pr.runs_of([[w.encode() for w in t] for t in texts], least)
    for t, rows in zip(texts, got, strict=True):
        assert [tuple(r) for r in rows.tolist()] == sorted(plain(t, least), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=14), st.integers(1, 30)), min_size=1, max_size=6))
def test_runs_of_repeated_blocks(blocks):
    check([list("".join(b * k for b, k in blocks))])


def test_runs_of_awkward_words():
    rng = random.Random(3)
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    meets = ["ab" * 60 + "a" + "ab" * 60, "a" * 100 + "b" + "a" * 100, "aab" * 50 + "ab" + "aab" * 45, "abaab" * 30 + "ab" + "abaab" * 33]
    nested = [("ab" * 40 + "a") * 4, ("aab" * 30 + "c") * 3, (("ab" * 12 + "a") * 3 + "b") * 4, ("a" * 50 + "b") * 6 + "a" * 30]
    mixed = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 200))) * rng.randrange(1, 4) + "".join(rng.choice("abc") for _ in range(40))
             for _ in range(40)]
    check([list(x) for x in [fib[-1], thue, *meets, *nested, *mixed, "", "a", "aa", "a" * 300]])
    many = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 300))] for _ in range(20)]
    check([t * rng.randrange(1, 5) + t[: rng.randrange(len(t) + 1)] for t in many])


def test_awkward_documents(spark):
    docs = awkward_docs(spark)
    looped = spark.createDataFrame([(900, "x y z " * 9 + "end"), (901, "a b\n" * 5 + "a")], "doc_id long, text string")
    docs = docs.unionByName(looped, allowMissingColumns=True)
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect())
    got = sorted((r.id is not None, r.id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(docs).collect())
    assert len(got) == len(want)
    for (_, _, text), (_, _, n, runs, out) in zip(want, got, strict=True):
        words = text.encode().split()
        assert n == len(words) and (len(words) > 2000 or runs == sorted(plain(words), key=lambda r: (r[0], r[2])))
        drop = {i for s, length, p in runs for i in range(s + p, s + length)}
        assert out == b" ".join(w for i, w in enumerate(words) if i not in drop).decode()
    assert pr.periodic_runs(empty_docs(spark)).collect() == []


def test_query_equals_plain_reading(spark):
    rows = {r.doc_id: r for r in catalog.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    seen = 0
    for d in docs:
        words = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:
            continue
        runs = sorted(plain(words), key=lambda r: (r[0], r[2]))
        drop = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = rows[d.doc_id]
        seen += len(runs)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()
    assert seen > 10


@pytest.mark.parametrize("n", [0, 1, 11, 12, 13])
def test_least_length(n):
    assert [x.tolist() for x in pr.runs_of([[b"a"] * n])] == [[[0, n, 1]] if n >= 12 else []]
