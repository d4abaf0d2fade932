import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.llm import line_dedup as ld
from tests.llm.fixtures import awkward_docs, empty_docs, sentence


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at, kind = rng.randrange(len(s)), rng.random()
        if kind < 0.4:
            s[at] = rng.choice("abé ")
        elif kind < 0.7:
            s.insert(at, rng.choice("abé"))
        else:
            del s[at]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_agrees_with_the_full_one(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(8, 20)))
        rows.append((a, edited(rng, a, rng.randrange(5))))
    rows = [(a, b, list(a), list(b)) for a, b in rows if len(b) > edits]
    df = spark.createDataFrame(rows, "a string, b string, x array<string>, y array<string>")
    got = df.select("a", "b", ld.within("x", "y", edits).alias("w")).collect()
    assert [r.w for r in got] == [distance(r.a, r.b) <= edits for r in got]


@pytest.mark.parametrize("edits", [1, 2])
def test_links_lose_no_pair(spark, edits):
    rng = random.Random(5)
    base = [sentence(rng, 5) for _ in range(25)]
    lines = sorted({x for b in base for x in [b, *(edited(rng, b, rng.randrange(1, 4)) for _ in range(4))] if "\n" not in x})
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    got = {(r.a, r.b) for r in ld.links(df, edits, 12).collect()}
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines))
            if min(len(lines[i]), len(lines[j])) >= 12 and distance(lines[i], lines[j]) <= edits}
    assert got == want and len(want) > 20
    assert {(r.a, r.b) for r in ld.links(df, edits, 12, broadcast_lines=0).collect()} == want


@pytest.mark.parametrize("edits", [1, 2])
def test_links_of_lines_of_every_length(spark, edits):
    rng = random.Random(6)
    lines = {"The anhely eran.", "The, anhely eran.", "Annd erhe.", "Annd hehe.", "a", "é", "ab", "x" * 23, "x" * 24}
    for _ in range(60):
        base = "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 26)))
        lines |= {base, edited(rng, base, 1) or "b"}
    lines = sorted(x for x in lines if x.strip())
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    got = [(r.a, r.b) for r in ld.links(df, edits).collect()]
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= edits}
    assert len(got) == len(set(got)) and set(got) == want


def brute(docs, edits=2, least=0, with_links=False):
    """{(id, text, line_no): (class place, copies, links)} by comparing all pairs."""
    occ = [((i is not None, i), t, k, line) for i, t in docs if t is not None for k, line in enumerate(t.split("\n")) if line.strip(" \t\n\r\x0b\x0c")]
    texts = sorted({o[3] for o in occ})
    # one edit changes the counts of two characters at most: others need no distance
    bags = np.array([np.bincount([ord(c) % 64 for c in t], minlength=64) for t in texts]).reshape(-1, 64)
    links = {}
    for a, bag in zip(texts, bags, strict=True):
        close = np.flatnonzero(np.abs(bags - bag).sum(1) <= 2 * edits)
        links[a] = {b for b in (texts[i] for i in close) if a != b and min(len(a), len(b)) >= least
                    and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    group = {}
    for t in texts:
        if t not in group:
            todo, members = [t], {t}
            while todo:
                for o in links[todo.pop()] - members:
                    members.add(o)
                    todo.append(o)
            for m in members:
                group[m] = frozenset(members)
    if with_links:
        return {o: (None, None, None, links[o[3]]) for o in occ}
    return {o: ({p[:3] for p in occ if p[3] in group[o[3]]}, sum(p[3] == o[3] for p in occ), len(links[o[3]])) for o in occ}


def staying(spark, docs, edits=2):
    """The texts that stay, taken in the order of their hashes, and {text: (id, line_no) of its first place}."""
    first, links = {}, {}
    for (key, _, k, line), (_, _, _, near) in brute(docs, edits, with_links=True).items():
        first[line] = min(first.get(line, (key, k)), (key, k))
        links[line] = near
    hashes = {r.x: r.h for r in spark.createDataFrame([(x,) for x in links], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    stays = set()
    for line in sorted(links, key=lambda x: hashes[x]):
        if not links[line] & stays:
            stays.add(line)
    return stays, {x: (key[1], k) for x, (key, k) in first.items()}


def templated(spark, n):
    return spark.range(n).select(F.col("id").alias("line_id"), F.format_string("Order number %06d has been shipped to the customer today", "id").alias("line"))


@pytest.mark.parametrize("crowd,few", [(512, 200_000), (8, 200_000), (8, 0)])
def test_crowded_keys_lose_no_link(spark, crowd, few):
    rows = templated(spark, 120).collect()
    got = [(r.a, r.b) for r in ld.links(templated(spark, 120), 2, broadcast_lines=few, crowd=crowd).collect()]
    want = {(a.line_id, b.line_id) for a in rows for b in rows if a.line_id < b.line_id and distance(a.line, b.line) <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_lines_that_go_are_near_one_that_stays(spark):
    """Chains of near lines: nothing goes that is farther than the limit from what stays, and what stays does not link."""
    rng = random.Random(8)
    lines = {"As.", "Erearend.", "Ontion.", "Pation.", "Thing."}
    for _ in range(5):
        line = "".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 30)))
        for _ in range(12):
            lines.add(line)
            line = edited(rng, line, 2) or "z"
    docs = [(i, x) for i, x in enumerate(sorted(x for x in lines if x.strip()))] + [(500, "As.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.id: r for r in ld.line_classes(df).withColumn("kept", ld.is_first()).collect()}
    text = dict(docs)
    stay = [text[i] for i, r in found.items() if r.kept]
    assert set(stay) == staying(spark, docs)[0] and len(stay) == len(set(stay))
    for i, r in found.items():
        assert r.kept or min(distance(text[i], x) for x in stay) <= 2
    assert all(distance(a, b) > 2 for a in stay for b in stay if a < b)
    out = {r.doc_id: r.text for r in ld.drop_repeated_lines(df, max_loss=None).collect()}
    assert {x for x in out.values() if x} == set(stay)


def test_columns_of_any_name_keep_their_values(spark):
    names = ["row", "key", "hash", "id", "th", "drop", "lost", "cells", "line", "line_no", "chars", "h1", "_drop", "_id", "_th", "_none", "_text_hash", "rows"]
    df = spark.createDataFrame([(1, "a first line here\nsecond one there"), (2, "a first line here\nown words, and many"), (None, None)], "doc_id long, text string")
    wide = df.select("*", *[F.lit(f"{n}!").alias(n) for n in names])
    out = ld.drop_repeated_lines(wide, max_loss=None)
    assert out.columns == wide.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "own words, and many" and got[1].text == df.first().text and got[None].text is None
    assert all(r[n] == f"{n}!" for r in got.values() for n in names)


def test_classes_on_awkward_documents(spark):
    docs = awkward_docs(spark, 25)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = ld.line_classes(docs).withColumn("kept", ld.is_first()).collect()
    by_hash = {}
    for i, t in rows:
        by_hash[spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]] = t
    assert len(got) == sum(1 for i, t in rows if t for line in t.split("\n") if line.strip(" \t\n\r\x0b\x0c"))
    seen = {}
    for r in got:
        t = by_hash[r.th]
        key = ((r.id is not None, r.id), t, r.line_no, t.split("\n")[r.line_no])
        places, copies, links = want[key]
        assert (r.n_copies, r.n_links) == (copies, links)
        assert (r["class"].id is not None, r["class"].id) == min(places, key=lambda p: (p[0][0], p[0][1] or 0))[0]
        seen.setdefault(r["class"], set()).add(key[:3])
        assert seen[r["class"]] <= places
    assert ld.line_classes(empty_docs(spark)).collect() == []


def test_dropping_lines_leaves_copies_whole_and_keeps_first_lines(spark):
    long = "a line that is long enough to be compared with others %d"
    docs = spark.createDataFrame([
        (1, "\n".join([long % 11, "only here one", "and this one is different from all"])),
        (2, "\n".join(["something of its own to say, at some length", long % 12, "", "a further line of its own, also rather long"])),
        (3, "\n".join([long % 11, "only here one", "and this one is different from all"])),
        (4, None), (5, ""), (None, "another text without an id")], "doc_id long, text string").withColumn("id", F.lit("x"))
    out = ld.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert len(got) == 6
    assert got[2] == "\n".join(["something of its own to say, at some length", "", "a further line of its own, also rather long"])
    assert got[3] == got[1] and got[4] is None and got[5] == "" and got[None] == "another text without an id"
    assert ld.drop_repeated_lines(empty_docs(spark)).count() == 0


def test_no_python_on_the_path(spark):
    plan = ld.line_classes(awkward_docs(spark, 5))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
