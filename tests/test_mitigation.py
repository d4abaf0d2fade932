"""The constrained grid: lattice, signed costs and the choice of the model."""

import pytest
from pyspark.sql import functions as F

from lendlens.operators import mitigation as M
from lendlens.plans import jobs as J


def population(spark, n=600):
    """Two groups whose labels follow x, with group b shifted down, and one row of no group."""
    df = spark.range(n).select(F.col("id").alias("application_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("g"),
                               ((F.col("id") * 37 % 101) / 100.0).alias("x"))
    df = df.withColumn("x", F.col("x") - F.when(F.col("g") == "b", 0.3).otherwise(0.0))
    return df.withColumn("label", (F.col("x") + (F.col("application_id") * 53 % 17) / 40.0 > 0.5).cast("int"))


@pytest.mark.parametrize("dims,size", [(0, 50), (1, 1), (1, 50), (3, 50), (30, 50), (4, 7)])
def test_grid(dims, size):
    grid = M.multiplier_grid(dims, size)
    assert len(grid) == (size if dims else 1) and len(set(grid)) == len(grid) and not any(grid[0])
    assert all(len(v) == dims and sum(map(abs, v)) <= 2.0 + 1e-12 for v in grid)


@pytest.mark.parametrize("constraint", [M.DEMOGRAPHIC_PARITY, M.EQUALIZED_ODDS])
def test_signed_gains_are_the_lagrangian(constraint):
    """For every 0/1 prediction per cell, error + multiplier terms equal a constant minus the gains of the cells predicted 1."""
    cells = {("a", 0): 30, ("a", 1): 20, ("b", 0): 25, ("b", 1): 5, (None, 0): 4, (None, 1): 16}
    total = sum(cells.values())
    keys = M.constraint_keys(cells, constraint)
    assert len(keys) == (2 if constraint == M.DEMOGRAPHIC_PARITY else 4)
    lam = {k: 0.3 * (i + 1) * (-1) ** i for i, k in enumerate(keys)}
    gains = M.signed_gains(cells, constraint, lam)

    def lagrangian(chosen):
        error = sum(n for (g, y), n in cells.items() if ((g, y) in chosen) != (y == 1)) / total

        def rate(test):
            return sum(n for c, n in cells.items() if c in chosen and test(c)) / sum(n for c, n in cells.items() if test(c))

        if constraint == M.DEMOGRAPHIC_PARITY:
            return error + sum(m * (rate(lambda c: c[0] == k[0]) - rate(lambda c: True)) for k, m in lam.items())
        return error + sum(m * (rate(lambda c: c == k) - rate(lambda c: c[1] == k[1])) for k, m in lam.items())

    names = list(cells)
    base = lagrangian(set())
    for bits in range(1 << len(names)):
        chosen = {c for i, c in enumerate(names) if bits >> i & 1}
        assert lagrangian(chosen) == pytest.approx(base - sum(gains[c] * cells[c] for c in chosen) / total)


@pytest.mark.parametrize("constraint", [M.DEMOGRAPHIC_PARITY, M.EQUALIZED_ODDS])
def test_chosen_model_is_fairer(spark, constraint):
    s = population(spark)
    train, valid = s.filter("application_id % 2 = 0"), s.filter("application_id % 2 = 1")
    model, table = M.constrained_grid(train.coalesce(2), valid.coalesce(2), "g", M.logistic_factory(["x"], ["g"], maxIter=20), constraint=constraint, grid_size=15, limit=0.4)
    rows = sorted(table.collect(), key=lambda r: r.candidate)
    best = next(r for r in rows if r.chosen)
    assert len(rows) == 15 and sum(r.chosen for r in rows) == 1
    assert best.gap < rows[0].gap and best.error + best.gap == min(r.error + r.gap for r in rows if r.gap <= rows[0].gap)
    pred = model.transform(valid.withColumn("__side", F.lit(0)))
    assert M.error_and_gap(pred, "g", "label", constraint) == (best.error, best.gap)
    with pytest.raises(ValueError):
        M.constrained_grid(train, valid, "g", M.logistic_factory(["x"]), constraint="none")


def test_cells_with_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 0), (None, 1), ("n", 0)], "g string, label int")
    cells = M.cells_of(df, "g", "label")
    assert cells == {("a", 1): 1, (None, 0): 1, (None, 1): 1, ("n", 0): 1}
    values = {c: float(i) for i, c in enumerate(cells)}
    got = df.select("g", "label", M._cell_value("g", "label", values).alias("v")).collect()
    assert all(r.v == values[r.g, r.label] for r in got)


def test_mitigation_job_searches_the_grid(spark):
    s = population(spark, 300)
    parts = [s.filter(f"application_id % 3 = {i}").withColumn("g", F.when(F.col("application_id") % 2 == 0, "a").otherwise("b")) for i in range(3)]
    _, report = J.mitigation_job(*parts, "g", ["x"], ["g"], grid_size=4, maxIter=2, maxDepth=2)
    assert {r.metric for r in report.collect()} == {"Demographic Parity Difference", "Equalized Odds Difference"}
