"""G1, exact: Shapley values of a tree ensemble's margin against a background.

A feature outside a coalition takes a background row's value, and the value of
a coalition is the mean margin over the background (Lundberg et al., 2020,
interventional form). For one leaf, one row x and one background row b, only
three kinds of features on the leaf's path matter: those whose tests x alone passes
(A), those b alone passes (B), and those neither passes, which rule the leaf
out. The leaf's share of a feature in A is then (|A|-1)! |B|! / (|A|+|B|)!
of its value, and minus |A|! (|B|-1)! / (|A|+|B|)! of one in B.

So a leaf needs to know of a row only which of its path's features pass: a bit
mask of at most tree-depth bits. One pass over the background counts the masks
per leaf, whatever its size; the counts, bounded by the model, become a table
from the explained row's mask to the shares, made tree by tree inside the tasks. A
second pass looks the rows up. There is no row x background x subset product,
and neither pass shuffles rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

MAX_CELLS = 1 << 24  # (leaf, mask) counts that may reach the driver
CHUNK = 4096  # rows looked up at a time


class Tree:
    """One weighted tree: its tests (slot, threshold or set of categories) and its leaves.

    A leaf is (value, players, needs): the players (feature numbers) on its path, and for
    each the (test, outcome) pairs that must hold."""

    def __init__(self, root, weight: float, player_of: list[int]):
        self.tests: list = []
        self.leaves: list[tuple[float, list[int], list[list[tuple[int, bool]]]]] = []
        self._walk(root, weight, player_of, [])

    def _walk(self, node, weight, player_of, path):
        if isinstance(node, float):
            players = sorted({player_of[self.tests[t][0]] for t, _ in path})
            needs = [[(t, o) for t, o in path if player_of[self.tests[t][0]] == p] for p in players]
            self.leaves.append((weight * node, players, needs))
            return
        slot, rule, left, right = node
        self.tests.append((slot, rule))
        t = len(self.tests) - 1
        self._walk(left, weight, player_of, [*path, (t, True)])
        self._walk(right, weight, player_of, [*path, (t, False)])

    def masks(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For every leaf, the mask of the players whose tests each row of x passes."""
        passed = [x[:, s] <= rule if isinstance(rule, float) else np.isin(x[:, s], rule) for s, rule in self.tests]
        for _, _, needs in self.leaves:
            mask = np.zeros(len(x), np.int64)
            for bit, pairs in enumerate(needs):
                ok = np.ones(len(x), bool)
                for t, outcome in pairs:
                    ok &= passed[t] if outcome else ~passed[t]
                mask |= ok.astype(np.int64) << bit
            yield mask


def parse_tree(text: str):
    """A tree from Spark's description of it: nested (slot, threshold | categories, left, right), leaves are floats."""
    lines = [line.strip() for line in text.split("\n")[1:] if line.strip()]
    at = 0

    def node():
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return float(line[8:])
        slot, rule = re.fullmatch(r"If \(feature (\d+) (.*)\)", line).groups()
        rule = float(rule[3:]) if rule.startswith("<= ") else [float(c) for c in rule[4:-1].split(",")]
        left = node()
        at += 1  # the line of the else branch repeats the test
        return int(slot), rule, left, node()

    return node()


def ensemble(trees: list, weights: list[float], player_of: list[int]) -> list[Tree]:
    """Trees as ``parse_tree`` gives them, with the player that each slot of the feature vector belongs to."""
    return [Tree(t, w, player_of) for t, w in zip(trees, weights, strict=True)]


def shares(value: float, counts: np.ndarray, n_players: int) -> np.ndarray:
    """(2^n, n): for every mask of an explained row, each player's share of the leaf, averaged over the background's mask counts."""
    size = 1 << n_players
    out = np.zeros((size, n_players))
    total, masks = counts.sum(), np.arange(size)
    full = size - 1
    bits = (masks[:, None] >> np.arange(n_players)) & 1
    weight = np.array([[factorial(max(a - 1, 0)) * factorial(b) / factorial(a + b) if a else 0.0 for b in range(n_players + 1)] for a in range(n_players + 1)])
    for b in np.flatnonzero(counts):
        ok = (masks | b) == full  # the others hold a feature that neither passes
        gain, loss = bits & (1 - bits[b]), bits[b] & (1 - bits)
        a_n, b_n = gain.sum(1), loss.sum(1)
        part = gain * weight[a_n, b_n][:, None] - loss * weight[b_n, a_n][:, None]
        out += np.where(ok[:, None], part, 0.0) * (value * counts[b] / total)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def mask_counts(background: DataFrame, vector: str, trees: list[Tree]) -> dict[tuple[int, int], np.ndarray]:
    """{(tree, leaf): how many background rows have each mask}. Tasks count; their sums are as large as the model."""
    if sum(1 << len(players) for t in trees for _, players, _ in t.leaves) > MAX_CELLS:
        raise ValueError("the trees are too deep for their mask counts to reach the driver; explain with permutation_shapley")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {(t, leaf): np.zeros(1 << len(players), np.int64) for t, tree in enumerate(trees) for leaf, (_, players, _) in enumerate(tree.leaves)}
        for b in batches:
            x = _matrix(b.column(0))
            for t, tree in enumerate(trees):
                for leaf, mask in enumerate(tree.masks(x) if len(x) else []):
                    found[t, leaf] += np.bincount(mask, minlength=len(found[t, leaf]))
        rows = [(t, leaf, m, n[m]) for (t, leaf), n in found.items() for m in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(4)], names=["tree", "leaf", "mask", "n"])

    counted = background.select(vector).mapInArrow(run, "tree long, leaf long, mask long, n long") \
        .groupBy("tree", "leaf", "mask").agg(F.sum("n").alias("n")).collect()
    out = {(t, leaf): np.zeros(1 << len(players), np.int64) for t, tree in enumerate(trees) for leaf, (_, players, _) in enumerate(tree.leaves)}
    for r in counted:
        out[r["tree"], r["leaf"]][r["mask"]] = r["n"]
    return out


def attributions(rows: DataFrame, background: DataFrame, vector: str, trees: list[Tree], players: list[str], out: str = "phi") -> tuple[DataFrame, float]:
    """``rows`` with ``out``, the Shapley value of every player (array of doubles, in the players' order), and the
    base value, the background's mean margin. ``vector`` names an array-of-double column of both tables, without nulls."""
    counts = mask_counts(background, vector, trees)
    n = sum(int(counts[0, leaf].sum()) for leaf in range(1)) if trees else 0
    if not n:
        raise ValueError("the background has no rows")
    base = sum(value * counts[t, leaf][-1] / n for t, tree in enumerate(trees) for leaf, (value, _, _) in enumerate(tree.leaves))
    n_players = len(players)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            parts = []
            for at in range(0, len(b), CHUNK):
                x = _matrix(b.column(b.num_columns - 1)[at:at + CHUNK])
                phi = np.zeros((len(x), n_players))
                for t, tree in enumerate(trees):
                    for leaf, mask in enumerate(tree.masks(x)):
                        value, on_path, _ = tree.leaves[leaf]
                        if on_path:
                            if (t, leaf) not in tables:
                                tables[t, leaf] = shares(value, counts[t, leaf], len(on_path))
                            phi[:, on_path] += tables[t, leaf][mask]
                parts.append(phi)
            flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * n_players, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], cells], names=[*kept, out])

    kept = [c for c in rows.columns if c not in (vector, out)]
    ordered = rows.select(*kept, vector)
    schema = ordered.drop(vector).schema.add(out, ArrayType(DoubleType()))
    return ordered.mapInArrow(run, schema), float(base)


def players_of(model: PipelineModel, df: DataFrame) -> tuple[list[str], list[int]]:
    """The source columns of a fitted pipeline's feature vector, and the column that each slot belongs to."""
    attrs = model.transform(df.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    slots = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    inputs = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    names = [c.rsplit("__", 1)[0] for c in inputs]
    order = sorted(range(len(inputs)), key=lambda i: -len(inputs[i]))  # the longest name that fits
    owner = [next(i for i in order if slots[s] == inputs[i] or slots[s].startswith(inputs[i] + "_")) for s in range(len(slots))]
    return names, owner


def tree_shapley(df: DataFrame, model: PipelineModel, background: DataFrame, key: str = "application_id", keep=()) -> tuple[DataFrame, float]:
    """G1 for a fitted gradient-boosted pipeline: (key, keep..., margin, contributions) and the base value.

    ``contributions`` is an array of (phi, feature, value) by phi, then feature, as
    the reason and record operators take it; ``value`` is the column's number (null for text). The phi of a row and the base add
    up to its margin, half the log odds. Encoded slots of one source column are one player, so a one-hot column gets one exact
    share. Any number of background rows will do: they are only counted."""
    names, owner = players_of(model, df)
    fitted = model.stages[-1]
    trees = ensemble([parse_tree(t.toDebugString) for t in fitted.trees], list(fitted.treeWeights), owner)
    encode = PipelineModel(model.stages[:-1])

    def vectors(rows: DataFrame, others) -> DataFrame:
        return encode.transform(rows).select(*others, vector_to_array("features").alias("_vector"))

    kinds = dict(df.dtypes)
    values = F.array(*[F.col(c).cast("double") if kinds.get(c) not in ("string", "binary") else F.lit(None).cast("double") for c in names]).alias("_values")
    rows = model.transform(df).select(key, *keep, vector_to_array("rawPrediction")[1].alias("margin"), values, vector_to_array("features").alias("_vector"))
    found, base = attributions(rows, vectors(background, []), "_vector", trees, names)
    cells = F.array_sort(F.transform(F.arrays_zip("phi", F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("_values").alias("value")),
                                     lambda c: F.struct(c["phi"].alias("phi"), c["feature"].alias("feature"), c["value"].alias("value"))))
    return found.select(key, *keep, "margin", cells.alias("contributions")), base
