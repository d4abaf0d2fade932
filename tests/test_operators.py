"""Invariants and small brute-force checks for aggregate operators."""

import math

from pyspark.sql import functions as F

from lendlens.operators import clean as CL
from lendlens.operators import explain as XP
from lendlens.operators import fairness as FA
from lendlens.operators import metrics as ME
from lendlens.sources import tables as TB
from tests.conftest import SF


def test_auc_matches_brute_force(spark):
    s = TB.scored_population(spark, SF)
    rows = s.select("label", "probability").collect()
    pos = [r.probability for r in rows if r.label == 1]
    neg = [r.probability for r in rows if r.label == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = ME.auc(s).first().auc
    assert math.isclose(got, brute, rel_tol=1e-9)


def test_reweighing_makes_label_independent(spark):
    """Weighted cell mass equals P(g) P(y) N: label and group independent under weights."""
    s = TB.scored_population(spark, SF)
    n = s.count()
    ng = {r[0]: r[1] for r in s.groupBy("lang").count().collect()}
    ny = {r[0]: r[1] for r in s.groupBy("label").count().collect()}
    w = FA.reweighing_weights(s, "lang").groupBy("lang", "label").agg(F.sum("weight").alias("w")).collect()
    for r in w:
        assert math.isclose(r.w, ng[r.lang] * ny[r.label] / n, rel_tol=1e-9)


def test_fairness_rows(spark):
    s = TB.scored_population(spark, SF).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    m = FA.metrics_by_group(s, ["lang"]).collect()
    groups = {r.group for r in m}
    assert "Overall" in groups and "Max Difference" in groups
    overall = next(r for r in m if r.group == "Overall")
    assert overall.sample_size == s.count()


def test_linear_shapley_efficiency(spark):
    apps = TB.applications(spark, SF).select("application_id", "credit_score", "age", "loan_amount")
    wts = {"credit_score": -0.01, "age": -0.02, "loan_amount": 0.0001}
    long, base = XP.linear_contributions(apps, wts, 1.0)
    sums = long.groupBy("application_id").agg(F.sum("phi").alias("s"))
    z = apps.select("application_id", (1.0 + sum(F.col(k) * v for k, v in wts.items())).alias("z"))
    bad = sums.join(z, "application_id").filter(F.abs(F.col("s") + F.lit(base) - F.col("z")) > 1e-6).count()
    assert bad == 0


def test_dedupe_keeps_smallest(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (2, "c", 9)], "k int, v string, o int")
    got = sorted(tuple(r) for r in CL.remove_duplicates(df, ["k"], order_by="o").collect())
    assert got == [(1, "b", 3), (2, "c", 9)]


def test_validation_messages(spark):
    df = spark.createDataFrame([(999, 30, 1000.0, 36), (700, 17, 0.0, 36)],
                               "credit_score int, age int, loan_amount double, loan_term int")
    v = CL.validate(df).collect()
    assert not v[0].is_valid and "Credit score 999" in v[0].errors[0]
    assert len(v[1].errors) == 2


def test_hash_split_is_stable(spark):
    s = TB.scored_population(spark, SF)
    a = ME.hash_split(s, "application_id").select("application_id", "split").collect()
    b = ME.hash_split(s.repartition(7), "application_id").select("application_id", "split").collect()
    assert sorted(a) == sorted(b)
