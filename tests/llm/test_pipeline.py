from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lendlens.llm import best_fit_packing as bp
from lendlens.llm import catalog, quality_rules
from lendlens.llm.common import staged
from tests.conftest import SF
from tests.llm.test_line_dedup import staying
from tests.llm.test_simhash_dedup import groups, plain


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_run_and_equal_their_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    assert rows
    if name in catalog.SQL:
        want = con.execute(catalog.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        at = [names.index(c) for c in sorted(names)]
        assert Counter(rows) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = staged(stage(spark, docs, SF), name)
        assert name == "best_fit_packing" or df.columns == docs.columns
        out[name], docs = df.collect(), df
    # quality
    rows = {i: t for i, t in rows.items() if not fails(t)}
    assert {r.doc_id: r.text for r in out["quality_rules"]} == rows
    # lines
    stays, first = staying(spark, list(rows.items()))
    new = {}
    for i, t in rows.items():
        lines = t.split("\n")
        keep = {(i, k): x in stays and first[x] == (i, k) for k, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")}
        new[i] = "\n".join(x for k, x in enumerate(lines) if keep.get((i, k), True))
        if not any(keep.get((i, k)) for k in range(len(lines))):
            del new[i]
    assert {r.doc_id: r.text for r in out["line_dedup"]} == new
    # near duplicates
    ids = list(new)
    first = set(groups(ids, [plain(new[i]) for i in ids], 4))
    assert {r.doc_id for r in out["simhash_dedup"]} == first
    # packing: every word of every document, and the plain search gives the same bins in each group
    size = Counter()
    for r in out["best_fit_packing"]:
        size[r.doc_id] += r.size
    assert size == {i: len(new[i].split()) for i in first}


def fails(text):
    m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text)))
    return any(eval(rule.replace("AND", "and"), dict(m)) for rule in quality_rules.RULES.values())


def test_run_returns_the_packing(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[0] == "doc_id" and "bin" in got.columns and got.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "best_fit_packing"]
    assert bp.GROUP > 0


def test_line_stage_drops_repeats_from_copies_too(spark):
    line = "a line that is long enough to be compared with others %s"
    docs = spark.createDataFrame([
        (1, "\n".join([line % "one", line % "and two"])), (2, "\n".join([line % "and two", "", line % "one"])),
        (3, "\n".join([line % "one", line % "and two", "its own"])), (4, None), (None, line % "zero, in a row without an id")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SF).collect()}
    assert got == {1: docs.first().text, 3: "its own", 4: None, None: line % "zero, in a row without an id"}


STRANGE = ["row", "key", "measured", "_n_words", "n_words", "_key", "_drop", "_id", "_th", "th", "fp", "rows", "least", "root", "cells", "drop", "lost", "hash"]


def test_stages_keep_columns_of_any_name(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " and more of its own\nin a second line"), (None, None), (4, "short")], "doc_id long, text string")
    wide = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)} | {c: F.lit(-7) for c in STRANGE})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[c] == -7 for r in rows for c in STRANGE), name
    assert dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, wide, SF).count() == 5


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
