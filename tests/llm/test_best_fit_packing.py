import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendlens.llm import best_fit_packing as bp
from tests.llm.fixtures import awkward_docs, empty_docs


def plain(sizes, conflicts, capacity):
    bins, out = [], []
    for i, size in enumerate(sizes):
        fits = [(b["rest"], k) for k, b in enumerate(bins) if b["rest"] >= size
                and all(c[i] is None or c[i] not in b["has"][n] for n, c in enumerate(conflicts))]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"rest": capacity, "has": [set() for _ in conflicts]})
        out.append((k, capacity - bins[k]["rest"]))
        bins[k]["rest"] -= size
        for n, c in enumerate(conflicts):
            bins[k]["has"][n].add(c[i])
    return out


piece = st.tuples(st.integers(0, 30), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3, 4, 5]))


@given(st.lists(piece, max_size=80))
@settings(max_examples=150, deadline=None)
def test_equals_a_plain_search(pieces):
    sizes, conflicts = [p[0] for p in pieces], [[p[1] for p in pieces], [p[2] for p in pieces]]
    assert list(zip(*bp.best_fit(sizes, conflicts, 30))) == plain(sizes, conflicts, 30)


def check(rows, placed, capacity):
    """Every word is placed once, bins hold no more than fits and no conflict."""
    bins, words = {}, {}
    for r in placed:
        bins.setdefault(r.bin, []).append(r)
        words.setdefault((r.id, r.copy), []).append((r.start, r.size))
    for members in bins.values():
        members.sort(key=lambda r: (r.offset, r.size))
        at = 0
        for r in members:
            assert r.offset == at
            at += r.size
        assert at <= capacity
    return bins, words


def test_awkward_documents(spark):
    docs = awkward_docs(spark).select("*", F.length(F.coalesce("text", F.lit(""))).alias("size"), F.xxhash64("text").alias("cluster"))
    got = bp.pack(docs, 700, group=16).collect()
    bins, words = check(docs, got, 700)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append((r.size, r.source, r.cluster))
    sized = {}
    for (i, _), spans in words.items():
        spans.sort()
        sized.setdefault(i, []).append(sum(s for _, s in spans))
        assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:]))
    # the two rows without an id differ, so both are copy 0
    assert {i: sum(s) for i, s in sized.items()} == {i: sum(x[0] for x in rows) for i, rows in want.items()}
    source = {i: rows[0][1] for i, rows in want.items() if i is not None}
    for members in bins.values():
        held = [source[r.id] for r in members if r.id is not None]
        assert len(held) == len(set(held))
    again = bp.pack(docs, 700, group=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_hot_source_and_copies(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 90), "hot" if i % 3 == 0 else f"s{i % 7}", i % 5) for i in range(600)] + [(1000, 10, "s1", 1)] * 4 + [(1001, None, None, None), (1002, -4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, source string, cluster long")
    got = bp.pack(docs, 100, group=64).collect()
    assert len(got) == len(rows)
    assert sorted(r.copy for r in got if r.id == 1000) == [0, 1, 2, 3]
    bins, _ = check(rows, got, 100)
    by_id = {r[0]: r for r in rows}
    for members in bins.values():
        for col in (2, 3):
            held = [by_id[r.id][col] for r in members if by_id[r.id][col] is not None]
            assert len(held) == len(set(held))


def test_empty_table(spark):
    docs = empty_docs(spark).withColumn("size", F.lit(1)).withColumn("cluster", F.lit(1))
    assert bp.pack(docs, 10).collect() == []


def test_clusters_of_the_query_are_near_copies(spark):
    from lendlens.llm import catalog
    from lendlens.llm import simhash_dedup as sd

    text = " ".join(f"w{i * i % 997}" for i in range(600))
    near = next(t for i in range(600) if (t := text.replace(f"w{i * i % 997}", "changed", 1)) != text
                and 0 < (sd.fingerprint(t) ^ sd.fingerprint(text)).bit_count() <= 4)
    rows = [(1, text, "a"), (2, near, "b"), (3, "quite another text " * 9, "c"), (4, None, "d"), (None, None, "e"), (None, text, "f")]
    got = catalog.packing_input(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    cluster = {r.source: r.cluster for r in got}
    assert len(got) == 6 and cluster["a"] == cluster["b"] == cluster["f"] != cluster["c"]
    assert cluster["c"] is not None and cluster["d"] is None and cluster["e"] is None
    assert {r.source: (r.doc_id, r["size"]) for r in got}["b"] == (2, 600) and {r.source: r["size"] for r in got}["d"] == 0
