"""Grid search by prefixes of one fit against separate fits."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lendlens.operators import grid as G
from lendlens.operators import model as MD
from lendlens.operators import rank as R
from lendlens.sources import tables as TB

SF01 = "/root/testdata/sf0.01"


def test_prefix_scores_equal_separate_fits(spark):
    s = TB.scored_population(spark, SF01).drop("probability")
    s = R.stratified_folds(s, "application_id", folds=2).checkpoint()

    def pipeline(**params):
        return MD.gbt_pipeline(["n_chars", "toxic"], ["source"], seed=5, **params)

    grid = {"maxDepth": [2, 3], "subsamplingRate": [0.8]}
    best, table = G.grid_search(s, pipeline, grid, trees=(4, 1, 2))
    rows = {(r.parameters["maxDepth"], r.trees): r for r in table.collect()}
    assert len(rows) == 6
    judge = BinaryClassificationEvaluator(labelCol="label")
    for (depth, k), r in rows.items():
        if k == 2 and depth == "3":
            continue
        aucs = []
        for fold in (0, 1):
            model = pipeline(maxIter=k, maxDepth=int(depth), subsamplingRate=0.8).fit(s.filter(F.col("fold") != fold))
            aucs.append(judge.evaluate(model.transform(s.filter(F.col("fold") == fold))))
        assert r.auc_mean == pytest.approx(np.mean(aucs), abs=1e-12) and r.auc_std == pytest.approx(np.std(aucs), abs=1e-12)
    top = max(rows.values(), key=lambda r: r.auc_mean)
    assert rows[str(best["maxDepth"]), best["maxIter"]].auc_mean == top.auc_mean
    assert np.prod([len(v) for v in G.DEFAULT_GRID.values()]) * len(G.DEFAULT_TREES) == 108
