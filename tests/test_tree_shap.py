"""Exact tree attributions against the enumeration of all coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.operators import model as MD
from lendlens.operators import tree_shap as TS
from lendlens.sources import tables as TB

SF01 = "/root/testdata/sf0.01"


def evaluate(node, x):
    while not isinstance(node, float):
        slot, rule, left, right = node
        node = left if (x[slot] <= rule if isinstance(rule, float) else x[slot] in rule) else right
    return node


def enumerated(f, x, background, owner, n):
    """Shapley values by the definition: coalitions of players, hybrids with every background row."""
    def value(s):
        rows = [[x[j] if owner[j] in s else b[j] for j in range(len(x))] for b in background]
        return sum(map(f, rows)) / len(rows)

    v = {s: value(set(s)) for k in range(n + 1) for s in combinations(range(n), k)}
    return [sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (v[tuple(sorted((*s, i)))] - v[s]) for s in v if i not in s)
            for i in range(n)], v[()]


def random_tree(rng, depth, slots):
    if depth == 0 or rng.random() < 0.15:
        return float(rng.normal())
    slot = int(rng.integers(slots))
    rule = float(rng.normal()) if slot % 3 else [float(c) for c in rng.choice(4, 2, replace=False)]
    return slot, rule, random_tree(rng, depth - 1, slots), random_tree(rng, depth - 1, slots)


@pytest.mark.parametrize("seed,n_players", [(1, 3), (2, 6), (3, 8)])
def test_equal_to_enumeration(spark, seed, n_players):
    rng = np.random.default_rng(seed)
    owner = list(range(n_players)) + [0, 1]  # two players own two slots each
    slots = len(owner)
    trees, weights = [random_tree(rng, 5, slots) for _ in range(4)], [1.0, 0.1, 0.1, 0.3]

    def draw(n):
        x = rng.normal(size=(n, slots))
        x[:, ::3] = rng.integers(0, 4, (n, len(range(0, slots, 3))))
        return [[float(v) for v in row] for row in x]

    rows, back = draw(12), draw(7)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id long, v array<double>")
    bg = spark.createDataFrame([(v,) for v in back], "v array<double>")
    found, base = TS.attributions(df, bg, "v", TS.ensemble(trees, weights, owner), [f"p{i}" for i in range(n_players)])
    got = {r.id: r.phi for r in found.collect()}
    for i, x in enumerate(rows):
        want, v0 = enumerated(lambda h: sum(w * evaluate(t, h) for t, w in zip(trees, weights, strict=True)), x, back, owner, n_players)
        assert base == pytest.approx(v0, abs=1e-9) and got[i] == pytest.approx(want, abs=1e-9)


def test_fitted_model(spark):
    s = TB.scored_population(spark, SF01).drop("probability")
    model = MD.gbt_pipeline(["n_chars", "toxic"], ["lang", "source"], maxIter=6).fit(s)
    bg = s.filter("application_id % 3 = 0")
    found, base = TS.tree_shapley(s, model, bg, keep=["lang"])
    assert found.columns == ["application_id", "lang", "margin", "contributions"]
    rows = found.collect()
    margins = {r.application_id: r.rawPrediction[1] for r in model.transform(s).select("application_id", "rawPrediction").collect()}
    mean = sum(r.rawPrediction[1] for r in model.transform(bg).select("rawPrediction").collect()) / bg.count()
    assert base == pytest.approx(mean, abs=1e-9) and len(rows) == s.count()
    for r in rows:
        assert [c.feature for c in sorted(r.contributions, key=lambda c: c.feature)] == ["lang", "n_chars", "source", "toxic"]
        assert r.margin == margins[r.application_id] and base + sum(c.phi for c in r.contributions) == pytest.approx(r.margin, abs=1e-9)
    # no shuffle of rows on the way
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == s._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_empty_background_and_single_leaf(spark):
    rows = spark.createDataFrame([(1, [0.5])], "id long, v array<double>")
    trees = TS.ensemble([2.5], [2.0], [0])
    found, base = TS.attributions(rows, rows, "v", trees, ["a"])
    assert base == 5.0 and found.first().phi == [0.0]
    with pytest.raises(ValueError):
        TS.attributions(rows, rows.limit(0), "v", trees, ["a"])
    none, _ = TS.attributions(rows.filter(F.lit(False)), rows, "v", trees, ["a"])
    assert none.collect() == []


def test_parsed_text():
    text = """DecisionTreeRegressionModel: uid=x, depth=2, numNodes=5, numFeatures=3
  If (feature 2 <= 1.5E-3)
   Predict: -0.25
  Else (feature 2 > 1.5E-3)
   If (feature 0 in {0.0,2.0})
    Predict: 1.0
   Else (feature 0 not in {0.0,2.0})
    Predict: 2.0
"""
    assert TS.parse_tree(text) == (2, 0.0015, -0.25, (0, [0.0, 2.0], 1.0, 2.0))


def test_reasons_of_denied_rows_come_from_the_trees(spark):
    from lendlens.plans import jobs as J

    s = TB.scored_population(spark, SF01).drop("probability")
    model = MD.gbt_pipeline(["n_chars", "toxic"], ["lang"], weight_col="weight", maxIter=4).fit(MD.class_weight_column(s))
    apps = s.withColumns({"credit_score": F.lit(700), "age": F.lit(30), "loan_amount": F.lit(1000.0), "loan_term": F.lit(36)})
    out = {r.application_id: r for r in J.batch_prediction_job(model, apps, ["n_chars", "toxic", "lang"], background=s).collect()}
    found, _ = TS.tree_shapley(s, model, s)
    denied = 0
    for r in found.collect():
        reasons = out[r.application_id].adverse_action_reasons
        if out[r.application_id].decision == "denied":
            denied += 1
            assert len(reasons) == min(3, sum(c.phi > 0 for c in r.contributions))
        else:
            assert reasons is None
    assert denied > 0
