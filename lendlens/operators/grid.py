"""Grid search that reuses the trees of one fit for every smaller number of trees.

Boosting adds trees one after another, and with one seed the first k trees of a
fit are the fit of k trees. So a grid over the number of trees needs only the
largest fit of each other combination: its margins after 50, 100 and 200 trees
come from one pass over the held-out rows, a third of the fits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lendlens.operators.tree_shap import CHUNK, _matrix, parse_tree
from lendlens.session import ensure_checkpoint_dir

DEFAULT_GRID = {"maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.3], "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["0.8", "1.0"]}
DEFAULT_TREES = (50, 100, 200)


def _leaves(node, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if isinstance(node, float):
        out[rows] = node
        return
    slot, rule, left, right = node
    ok = x[rows, slot] <= rule if isinstance(rule, float) else np.isin(x[rows, slot], rule)
    _leaves(left, x, rows[ok], out)
    _leaves(right, x, rows[~ok], out)


def prefix_margins(rows: DataFrame, vector: str, trees: list, weights: list[float], cuts: list[int], out: str = "margins") -> DataFrame:
    """``rows`` with the margins after the first ``cuts`` trees, in the order of ``cuts``; ``vector`` is an array of doubles."""
    last = {c: [i for i, k in enumerate(cuts) if k == c] for c in cuts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.slice(at, CHUNK)
                x = _matrix(part.column(part.num_columns - 1))
                margin, found, each = np.zeros(len(x)), np.zeros((len(x), len(cuts))), np.empty(len(x))
                for t, (tree, weight) in enumerate(zip(trees, weights, strict=True), 1):
                    _leaves(tree, x, np.arange(len(x)), each)
                    margin += weight * each
                    for i in last.get(t, []):
                        found[:, i] = margin
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(cuts), pa.int32()), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], cells], names=[*kept, out])

    kept = [c for c in rows.columns if c not in (vector, out)]
    ordered = rows.select(*kept, vector)
    return ordered.mapInArrow(run, ordered.drop(vector).schema.add(out, ArrayType(DoubleType())))


def fold_aucs(model: PipelineModel, held_out: DataFrame, label: str, cuts: list[int]) -> list[float]:
    """The AUC of the model's first ``cuts`` trees on the held-out rows."""
    fitted = model.stages[-1]
    trees, weights = [parse_tree(t.toDebugString) for t in fitted.trees], list(fitted.treeWeights)
    rows = PipelineModel(model.stages[:-1]).transform(held_out).select(F.col(label).alias("label"), vector_to_array("features").alias("vector"))
    scored = prefix_margins(rows, "vector", trees, weights, cuts).checkpoint()
    judge = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="margin")
    return [judge.evaluate(scored.select("label", F.col("margins")[i].alias("margin"))) for i in range(len(cuts))]


def grid_search(train: DataFrame, pipeline: Callable[..., Pipeline], grid: dict[str, list] | None = None, trees=DEFAULT_TREES, label: str = "label",
                folds_col: str = "fold", threads: int = 4) -> tuple[dict, DataFrame]:
    """(best parameters, table of (parameters, trees, auc_mean, auc_std) over the folds).

    ``pipeline(maxIter=..., **parameters)`` makes an unfitted pipeline ending in a GBT classifier with a fixed seed; ``trees``
    are the numbers of trees to compare. Fits run for the largest number alone, at most ``threads`` at once over one written table. The default
    grid is that of 108 combinations, in 36 fits a fold. Ties go to the earlier combination."""
    ensure_checkpoint_dir(train.sparkSession)
    train = train.checkpoint()
    grid = DEFAULT_GRID if grid is None else grid
    combos = [dict(zip(grid, v, strict=True)) for v in product(*grid.values())]
    folds = sorted(r[0] for r in train.select(folds_col).distinct().collect())
    cuts = sorted(trees)

    def one(job):
        params, fold = job
        model = pipeline(maxIter=cuts[-1], **params).fit(train.filter(F.col(folds_col) != fold))
        return fold_aucs(model, train.filter(F.col(folds_col) == fold), label, cuts)

    with ThreadPoolExecutor(threads) as pool:
        results = list(pool.map(one, [(p, f) for p in combos for f in folds]))
    aucs = np.array(results).reshape(len(combos), len(folds), len(cuts))
    rows = [({k: str(v) for k, v in p.items()}, k, float(aucs[i, :, c].mean()), float(aucs[i, :, c].std()))
            for i, p in enumerate(combos) for c, k in enumerate(cuts)]
    best = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    table = train.sparkSession.createDataFrame(rows, "parameters map<string,string>, trees int, auc_mean double, auc_std double")
    return {**combos[best // len(cuts)], "maxIter": rows[best][1]}, table
