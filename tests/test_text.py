"""Scalar text operators on the reference's own examples (corrected parsing)."""

import pytest
from pyspark.sql import functions as F

from lendlens.functions import text as T
from lendlens.operators import documents as D
from lendlens.operators import features as FE

CATEGORY_CASES = [
    ("DIRECT DEPOSIT PAYROLL", "Income"), ("ACH DEPOSIT SALARY", "Income"),
    ("AUTO LOAN PAYMENT", "Debt_EMI"), ("MORTGAGE PMT", "Debt_EMI"),
    ("OVERDRAFT FEE", "Risk_Flag"), ("NSF FEE", "Risk_Flag"),
    ("STARBUCKS #1234", "Discretionary"), ("NETFLIX SUBSCRIPTION", "Discretionary"),
    ("PG&E UTILITY BILL", "Utility"), ("RANDOM STORE", "Other"),
]

SAMPLE = "\n".join([
    "08/01/2024 DIRECT DEPOSIT PAYROLL $5200.00",
    "08/03/2024 AUTO LOAN PMT -$450.00",
    "08/05/2024 STARBUCKS #1234 -$5.50",
    "08/08/2024 OVERDRAFT FEE -$35.00",
    "08/15/2024 DIRECT DEPOSIT PAYROLL $5200.00",
    "08/20/2024 NETFLIX SUBSCRIPTION -$15.99",
])


def test_transaction_categories(spark):
    df = spark.createDataFrame(CATEGORY_CASES, "d string, want string")
    got = df.select("want", T.categorize_transaction("d").alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_line_categories_and_null(spark):
    df = spark.createDataFrame([("PAYROLL deposit",), ("casino night",), ("",), (None,), ("hello",)], "t string")
    got = [r[0] for r in df.select(T.categorize("t")).collect()]
    assert got == ["salary", "gambling", "unknown", "unknown", "other"]


def test_amounts(spark):
    df = spark.createDataFrame([("08/01/2024 PAY $5,200.00",), ("08/03/2024 LOAN -$450.00",), ("no money",)], "t string")
    got = [float(r[0]) for r in df.select(T.extract_amount("t")).collect()]
    assert got == [5200.0, 450.0, 0.0]
    first = [float(r[0]) for r in df.select(T.extract_amount("t", "first_token")).collect()]
    assert first[0] == 8.0  # the older first-token behaviour reads the month


def test_parse_transactions_sample(spark):
    st = spark.createDataFrame([(1, SAMPLE)], "application_id long, statement_text string")
    t = FE.parse_transactions(st).orderBy("line_no").collect()
    assert len(t) == 6
    assert [float(r.amount) for r in t][:4] == [5200.0, -450.0, -5.5, -35.0]
    assert [r.category for r in t] == ["Income", "Debt_EMI", "Discretionary", "Risk_Flag", "Income", "Discretionary"]


def test_transaction_features_sample(spark):
    st = spark.createDataFrame([(1, SAMPLE)], "application_id long, statement_text string")
    f = FE.transaction_features(FE.parse_transactions(st)).first()
    assert f.avg_salary_deposit == 5200.0
    assert f.risk_flag_count == 1
    assert f.num_transactions == 6
    assert f.monthly_emi_total == 450.0
    assert abs(f.avg_discretionary_spend - 21.49) < 1e-9
    assert abs(f.utilization_ratio_proxy - 471.49 / 5200) < 1e-9
    assert f.statement_date_range_days == 19
    assert f.days_between_paychecks_mean == 14.0
    assert f.income_stability_variance == 0.0  # equal deposits: exactly zero


def test_income_only_sample(spark):
    text = "\n".join(["08/01/2024 DIRECT DEPOSIT PAYROLL $5200.00", "08/15/2024 DIRECT DEPOSIT PAYROLL $5200.00",
                      "09/01/2024 DIRECT DEPOSIT PAYROLL $5200.00"])
    st = spark.createDataFrame([(1, text)], "application_id long, statement_text string")
    f = FE.transaction_features(FE.parse_transactions(st)).first()
    assert f.avg_salary_deposit == 5200.0 and f.num_income_deposits == 3


def test_risk_flags(spark):
    text = "\n".join(["08/01/2024 OVERDRAFT FEE -$35.00", "08/02/2024 NSF FEE -$30.00", "08/03/2024 GROCERY -$20.00"])
    st = spark.createDataFrame([(1, text)], "application_id long, statement_text string")
    assert FE.transaction_features(FE.parse_transactions(st)).first().risk_flag_count == 2


def test_currency_and_dates(spark):
    df = spark.createDataFrame([("$1,234.56",), ("$1234.56",), ("1234",), ("$1,234",)], "v string")
    assert [r[0] for r in df.select(T.currency_scalar("v")).collect()] == [1234.56, 1234.56, 1234.0, 1234.0]
    d = spark.createDataFrame([("Pay period: 01/01/2024 - 01/15/2024",)], "t string")
    assert d.select(T.all_dates("t")).first()[0] == ["01/01/2024", "01/15/2024"]
    p = spark.createDataFrame([("2024-03-05",), ("03/05/2024",), ("Mar 05, 2024",), ("nope",)], "t string")
    got = [str(r[0]) for r in p.select(T.parse_date("t")).collect()]
    assert got == ["2024-03-05", "2024-03-05", "2024-03-05", "None"]


def test_document_fields(spark):
    stub = "ACME CORP\nPay period: 01/01/2024 - 01/15/2024\nGross Pay: $5,000.00\nNet Pay: $4,000.00"
    bank = "Chase Bank statement\nEnding Balance: $10,500.00"
    df = spark.createDataFrame([(stub, "paystub"), (bank, "bank_statement")], "raw_text string, document_type string")
    a, b = D.extract_document_fields(df).collect()
    assert (a.gross_income, a.net_income, a.pay_period_start, a.pay_period_end) == (5000.0, 4000.0, "01/01/2024",
                                                                                   "01/15/2024")
    assert (b.bank_name, b.account_balance) == ("Chase", 10500.0)


def test_clean_text(spark):
    df = spark.createDataFrame([("  Hello,\t\tworld!  $5.00 #x  ",)], "t string")
    assert df.select(T.clean_text("t")).first()[0] == "Hello, world $5.00 x"


def test_plan_has_no_python_udf(spark):
    st = spark.createDataFrame([(1, SAMPLE)], "application_id long, statement_text string")
    plan = FE.statement_features(st)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_tfidf_evaluates_the_tokens_once_per_scan(spark):
    """No filter on the counts may be pushed below the projection and repeat the tokens inside it."""
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta gamma"), (3, ""), (4, None)], "doc_id long, text string")
    kept = docs.select("doc_id", D.unigrams("text").alias("_k")).select("doc_id", "_k")
    plan = D.tfidf(docs, vocab_size=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # the counted rows were written once
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = {(r.doc_id, r.term): r.tf for r in D.tfidf(docs, vocab_size=3).collect()}
    assert got == {(1, "alpha"): 2, (1, "beta"): 1, (2, "beta"): 1, (2, "gamma"): 1}
    maps = {r.doc_id: r.tfidf_terms for r in D.tfidf_maps(docs.unionAll(docs), vocab_size=3).collect()}
    want = {}
    for r in D.tfidf(docs.unionAll(docs), vocab_size=3).collect():
        want.setdefault(r.doc_id, {}).setdefault(r.term, 0.0)
        want[r.doc_id][r.term] += r.tfidf
    assert set(maps) == set(want) and all(maps[k][t] == pytest.approx(w) for k, m in want.items() for t, w in m.items())


@pytest.mark.parametrize("literal", [20_000, 0])
def test_names_of_a_long_dictionary(spark, literal):
    import random
    rng = random.Random(2)
    letters = "abcdeé "
    names = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(1500)} | {"Chase", "BANK of x", "", "(a.*"}
    names = [(n, i % 700) for i, n in enumerate(sorted(names))] + [(None, 0), ("Chase", 3)]
    docs = [(i, "".join(rng.choice(letters + "xyz") for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    docs += [(100, "PURCHASE at bank OF X"), (101, None), (102, ""), (103, "y(a.*z"), (None, "chase"), (104, "zzzz"), (104, "chase")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    n = spark.createDataFrame(names, "name string, priority int")
    got = {r.doc_id: r.name for r in D.listed_names(d, n, literal_grams=literal).collect()}
    want = {}
    for i, t in docs:
        hits = [(p, x) for x, p in names if x and t is not None and x.lower() in t.lower()]
        if hits:
            want[i] = min([min(hits), *([want[i]] if i in want else [])])
    assert got == {i: x for i, (_, x) in want.items()} and len(got) > 60


def test_texts_send_little_but_the_names_they_hold(spark):
    """What the texts of a long list send does not grow with their other characters."""
    import random
    rng = random.Random(5)
    def word():
        return "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    docs = [(i, " ".join(word() for _ in range(300))) for i in range(150)]
    listed = {" ".join(t.split(" ")[2:4]) for _, t in docs} | {f"{word()} {word()}" for _ in range(3000)} | {"x" * 90, "abc"}
    index = spark.createDataFrame([(n,) for n in listed], "low string")
    texts = spark.createDataFrame(docs, "key long, text string")
    held = {(i, n) for i, t in docs for n in listed if n in t}
    sent = [(r.key, r.low) for r in D.names_asked(texts, index, []).collect()]
    assert held <= set(sent) and len(sent) == len(set(sent)) <= len(held) + 10 * len(docs)
    first = sorted(listed)[:2000]
    alone = [(r.key, r.low) for r in D.names_asked(texts, index, first).collect()]
    for i in {i for i, n in held if n in set(first)}:
        assert [n for k, n in alone if k == i] == [min(n for k, n in held if k == i)]


def test_vocabulary_by_two_passes_equals_full_counts(spark):
    import random
    from collections import Counter
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights=[300 / (k + 1) for k in range(300)], k=80))) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    count = Counter(w for _, t in docs for w in (t or "").split())
    want = dict(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:10])
    found = D.heavy_terms(df, D.unigrams("text"), 10)
    assert found == want and list(found) == list(want)
    # a summary too small to tell says so, and the full counts give the same vocabulary
    assert D.heavy_terms(df, D.unigrams("text"), 290, tracked=32) is None
    flat = spark.createDataFrame([(i, f"only{i} once{i}") for i in range(500)], "doc_id long, text string")
    assert D.heavy_terms(flat, D.unigrams("text"), 10, tracked=64) is None
    assert D.top_vocabulary(flat, D.unigrams("text"), 3) == ["once0", "once1", "once10"]
    assert D.heavy_terms(df.limit(0), D.unigrams("text"), 10) == {}


@pytest.mark.parametrize("tracked", [1 << 14, 32])
def test_pairs_are_counted_from_the_frequent_words_alone(spark, tracked, monkeypatch):
    import random
    from collections import Counter
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights=[400 / (k + 1) ** 1.5 for k in range(400)], k=60))) for i in range(150)] + [(900, None), (901, ""), (902, "w0"), (903, "w0 w0 w0"), (3, "w1 w0")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    count = Counter()
    for _, t in docs:
        k = (t or "").split()
        count.update(k + [f"{a} {b}" for a, b in zip(k, k[1:])])
    want = [t for t, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:20]]
    assert any(" " in t for t in want)
    found = D.frequent_ngrams(df, "doc_id", "text", 20, tracked=tracked)
    assert found[2] == want  # a summary of 32 words cannot tell; the counts of all words do
    assert D.frequent_ngrams(df, "doc_id", "text", 399, tracked=32, most=2) is None
    if tracked > 32:  # nothing is left of other words
        kept = {w for r in found[0].collect() for w in r["_w"] or [] if w}
        assert len(kept) <= 80 and {r.term for r in D.tfidf_ngrams(df, max_features=20).collect()} == set(want)
        # the result is that of the counts of all terms
        by_words = sorted(map(tuple, D.tfidf_ngrams(df, max_features=20).collect()))
        monkeypatch.setattr(D, "frequent_ngrams", lambda *a, **k: None)
        assert by_words == sorted(map(tuple, D.tfidf_ngrams(df, max_features=20).collect()))


def test_modes_of_all_columns_in_one_pass(spark):
    from lendlens.operators import clean as CL
    df = spark.createDataFrame([(1, "b", 2.0, None), (2, "a", 2.0, None), (None, None, None, None), (2, "b", 1.0, None), (1, "a", None, None)],
                               "n int, s string, x double, z string")
    got = CL.impute(df, numeric=["n", "x"], categorical=["s", "z"], strategy="mode").collect()
    assert [(r.n, r.s, r.x, r.z) for r in got][2] == (1.0, "a", 2.0, None)
