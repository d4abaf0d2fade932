import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendlens.llm import quality_rules as qr
from tests.llm.fixtures import awkward_docs, empty_docs


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines))


@given(st.text(alphabet="ab \n\t#é|\x0b\xa0", max_size=120))
@settings(max_examples=300, deadline=None)
def test_measurements_equal_a_plain_count(text):
    assert qr.measure(text) == plain(text)
    assert qr.measure(None) == (0,) * 6


def test_ledger_policies_and_ablations(spark):
    docs = awkward_docs(spark)
    book = qr.ledger(docs)
    rows = book.collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((str(r.id), tuple(r[m] for m in qr.MEASURES)) for r in rows) == sorted((str(i), plain(t)) for i, t in texts)
    rules = list(qr.RULES)
    for r in rows:
        m = {k: r[k] for k in qr.MEASURES}
        assert r.failed == sum(1 << i for i, k in enumerate(rules) if eval(qr.RULES[k].replace("AND", "and"), m))
    for policy in (qr.BASE, qr.STANDARD, qr.LENIENT):
        fails = [[k for k in policy.rules if r.failed >> rules.index(k) & 1] for r in rows]
        kept = [len(f) <= policy.allowed for f in fails]
        assert [r.kept for r in qr.apply_policy(book, policy).orderBy(F.monotonically_increasing_id()).collect()].count(True) == sum(kept)
        got = {r.rule: r for r in qr.ablations(book, policy).collect()}
        assert set(got) == set(policy.rules)
        for k in policy.rules:
            without = [len([x for x in f if x != k]) <= policy.allowed for f in fails]
            assert (got[k].n_failed, got[k].n_only, got[k].n_kept_without) == (
                sum(k in f for f in fails), sum(a and not b for a, b in zip(without, kept)), sum(without))
    good = qr.keep_good(docs)
    assert good.columns == docs.columns
    bad = {(r.id, r.n_words) for r in rows if r.failed}
    assert good.count() == sum(not r.failed for r in rows) and bad
    assert qr.ledger(empty_docs(spark)).collect() == [] and qr.keep_good(empty_docs(spark)).collect() == []
    assert qr.ablations(qr.ledger(empty_docs(spark)), qr.BASE).collect() == []
