"""H5: a grid of cost-sensitive models under a fairness constraint.

The reductions approach (Agarwal et al., 2018): a parity constraint with
Lagrange multipliers adds to the error a cost of predicting 1 that depends on a
row's group (and label) alone, so every vector of multipliers is an ordinary
weighted fit: a row's label becomes the side that is cheaper, its weight the difference.
The grid is a lattice of multipliers, zero first; zero is the unconstrained model.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.operators import model as mdl
from lendlens.session import ensure_checkpoint_dir

DEMOGRAPHIC_PARITY, EQUALIZED_ODDS = "demographic_parity", "equalized_odds"
MAX_GROUPS = 1000  # groups are counted on the driver


def multiplier_grid(dims: int, size: int, limit: float = 2.0) -> list[tuple[float, ...]]:
    """``size`` vectors of ``dims`` multipliers, zero first, spread over a lattice of L1 norm at most ``limit``."""
    if size < 1:
        raise ValueError("the grid needs a model")
    if dims == 0:
        return [()]

    def ball(d: int, units: int):
        if d == 0:
            yield ()
            return
        for x in sorted(range(-units, units + 1), key=abs):
            for rest in ball(d - 1, units - abs(x)):
                yield (x, *rest)

    def count(d: int, units: int) -> int:  # points of the lattice ball
        row = [1] * (units + 1)
        for _ in range(d):
            row = [sum(row[u - abs(x)] for x in range(-u, u + 1)) for u in range(units + 1)]
        return row[units]

    units = next(u for u in range(1, size + 1) if count(dims, u) >= size)
    points = sorted(ball(dims, units), key=lambda p: (sum(map(abs, p)), p))
    picked = [points[0]] + [points[1 + i * (len(points) - 1) // max(size - 1, 1)] for i in range(size - 1)]
    return [tuple(limit * x / units for x in p) for p in picked]


def cells_of(train: DataFrame, group: str, label: str) -> dict[tuple, int]:
    """{(group, label): rows}, groups as text, null a group of its own."""
    rows = train.groupBy(F.col(group).cast("string").alias("g"), F.col(label).cast("int").alias("y")).count().limit(2 * MAX_GROUPS + 1).collect()
    if len(rows) > 2 * MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    return {(r["g"], r["y"]): r["count"] for r in rows}


def constraint_keys(cells: dict[tuple, int], constraint: str) -> list[tuple]:
    """What a multiplier belongs to: a group, or a group and a label; the largest group (of the label) has none, as gaps are relative."""
    def by_size(keys, size):
        return sorted(keys, key=lambda k: (-size(k), k is None, str(k)))

    if constraint == DEMOGRAPHIC_PARITY:
        groups = by_size({g for g, _ in cells}, lambda g: sum(n for (h, _), n in cells.items() if h == g))
        return [(g,) for g in groups[1:]]
    if constraint == EQUALIZED_ODDS:
        return [(g, y) for y in (0, 1) for g in by_size({g for g, z in cells if z == y}, lambda g, y=y: cells[g, y])[1:]]
    raise ValueError(f"unknown constraint: {constraint}")


def signed_gains(cells: dict[tuple, int], constraint: str, multipliers: dict[tuple, float]) -> dict[tuple, float]:
    """{(group, label): how much better predicting 1 is than 0} in the Lagrangian of error and constraint."""
    total = sum(cells.values())
    out = {}
    for g, y in cells:
        if constraint == DEMOGRAPHIC_PARITY:
            share = sum(n for (h, _), n in cells.items() if h == g) / total
            cost = multipliers.get((g,), 0.0) / share - sum(multipliers.values())
        else:
            of_label = sum(n for (_, z), n in cells.items() if z == y) / total
            cost = multipliers.get((g, y), 0.0) * total / cells[g, y] - sum(m for (_, z), m in multipliers.items() if z == y) / of_label
        out[g, y] = (2 * y - 1) - cost
    return out


def _cell_value(group: str, label: str, values: dict[tuple, float]) -> Column:
    """The cell's value by a lookup in a literal map of at most 2 MAX_GROUPS entries."""
    key = F.concat(F.when(F.col(group).isNull(), "n").otherwise(F.concat(F.lit("g"), F.col(group).cast("string"))), F.lit(":"), F.col(label).cast("int").cast("string"))
    cells = F.create_map(*[x for (g, y), v in values.items() for x in (F.lit(f"{'n' if g is None else 'g' + g}:{y}"), F.lit(float(v)))])
    return F.element_at(cells, key)


def error_and_gap(pred: DataFrame, group: str, label: str, constraint: str) -> tuple[float, float]:
    """Error rate and parity gap of 0/1 predictions, from one aggregate of a row per group."""
    y, p = F.col(label) == 1, F.col("prediction") == 1
    rows = pred.groupBy(group).agg(F.count("*").alias("n"), F.count_if(y).alias("pos"), F.count_if(p).alias("chosen"),
                                   F.count_if(y & p).alias("tp"), F.count_if(y != p).alias("wrong")).collect()

    def spread(parts):
        rates = [a / b for a, b in parts if b]
        return max(rates) - min(rates) if rates else 0.0

    if constraint == DEMOGRAPHIC_PARITY:
        gap = spread([(r["chosen"], r["n"]) for r in rows])
    else:
        gap = max(spread([(r["tp"], r["pos"]) for r in rows]), spread([(r["chosen"] - r["tp"], r["n"] - r["pos"]) for r in rows]))
    total = sum(r["n"] for r in rows)
    return (sum(r["wrong"] for r in rows) / total if total else 0.0), gap


def constrained_grid(train: DataFrame, valid: DataFrame, group: str, pipeline: Callable[[str, str], Pipeline], label: str = "label",
                     constraint: str = EQUALIZED_ODDS, grid_size: int = 50, limit: float = 2.0, threads: int = 4) -> tuple[PipelineModel, DataFrame]:
    """H5: ``grid_size`` fits over a lattice of multipliers; (chosen model, table of candidates).

    ``pipeline(label column, weight column)`` makes an unfitted pipeline that ends in a binary classifier. Every
    candidate is judged on ``valid``; of those whose gap is at most the unconstrained model's (candidate 0) the
    one with the lowest error + gap is chosen. At most ``threads`` fits run at once over one written training table.
    Rows that cost the same either way have no weight; a candidate whose rows all get one label
    predicts it. Labels are 0 or 1, not null."""
    ensure_checkpoint_dir(train.sparkSession)
    train, valid = train.checkpoint(), valid.checkpoint()
    cells = cells_of(train, group, label)
    keys = constraint_keys(cells, constraint)
    grid = [dict(zip(keys, v, strict=True)) for v in multiplier_grid(len(keys), grid_size, limit)]

    def fit(multipliers):
        gains = signed_gains(cells, constraint, multipliers)
        gain = _cell_value(group, label, gains)
        rows = train.withColumns({"__side": F.when(gain > 0, 1).otherwise(0), "__cost": F.abs(gain)}).filter("__cost > 0")
        fitted = pipeline("__side", "__cost").fit(rows)
        sides = {g > 0 for g in gains.values() if g != 0}
        pred = fitted.transform(valid.withColumn("__side", F.lit(0))) if len(sides) > 1 else valid.withColumn("prediction", F.lit(1.0 if True in sides else 0.0))
        return (fitted, *error_and_gap(pred, group, label, constraint))

    with ThreadPoolExecutor(threads) as pool:
        results = list(pool.map(fit, grid))
    allowed = [i for i, (_, _, gap) in enumerate(results) if gap <= results[0][2]]
    best = min(allowed, key=lambda i: (results[i][1] + results[i][2], i))
    rows = [(i, {", ".join(map(str, k)): v for k, v in m.items()}, constraint, float(e), float(g), i == best) for i, (m, (_, e, g)) in enumerate(zip(grid, results, strict=True))]
    table = train.sparkSession.createDataFrame(rows, "candidate int, multipliers map<string,double>, constraint string, error double, gap double, chosen boolean")
    return results[best][0], table


def gbt_factory(numeric, categorical=(), seed: int = 42, **params) -> Callable[[str, str], Pipeline]:
    return lambda label, weight: mdl.gbt_pipeline(numeric, categorical, label=label, weight_col=weight, seed=seed, **params)


def logistic_factory(numeric, categorical=(), **params) -> Callable[[str, str], Pipeline]:
    from pyspark.ml.classification import LogisticRegression
    stages, _ = mdl.preprocessing_stages(list(numeric), list(categorical))
    return lambda label, weight: Pipeline(stages=[*stages, LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight, **params)])
