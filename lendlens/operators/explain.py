"""Per-decision explanations: attributions, reasons, records, global importance.

Attributions are a long table ``(key, feature, value, phi)``. Everything
after that is either an in-row array operation (reasons, records) or an
aggregate / window whose partition is one application's features (bounded
by the number of features), so nothing grows with the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions import rules

KEY = "application_id"


def linear_contributions(df: DataFrame, weights: dict[str, float], intercept: float = 0.0,
                         key: str = KEY, background: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Exact Shapley values of a linear score: phi_j = w_j (x_j - mean_j),
    with means over ``background`` (default: ``df``). Returns the long table
    and the base value ``intercept + sum_j w_j mean_j``."""
    bg = background if background is not None else df
    feats = list(weights)
    means = bg.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats]).first().asDict()
    base = intercept + sum(weights[f] * means[f] for f in feats)
    cols = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                     (F.lit(weights[f]) * (F.col(f).cast("double") - F.lit(means[f]))).alias("phi"))
            for f in feats]
    long = df.select(key, F.explode(F.array(*cols)).alias("c")).select(key, "c.feature", "c.value", "c.phi")
    return long, base


def linear_contribution_rows(df: DataFrame, weights: dict[str, float], intercept: float = 0.0,
                             background: DataFrame | None = None) -> tuple[DataFrame, float]:
    """G1b inside the row: ``df`` with its contributions as a sorted array (phi
    ascending, ties by feature) -- no explode and no regrouping -- and the base value."""
    bg = background if background is not None else df
    means = bg.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in weights]).first().asDict()
    cells = [F.struct((F.lit(w) * (F.col(f).cast("double") - F.lit(means[f]))).alias("phi"), F.lit(f).alias("feature"),
                      F.col(f).cast("double").alias("value")) for f, w in weights.items()]
    base = intercept + sum(weights[f] * means[f] for f in weights)
    return df.withColumn("contributions", F.array_sort(F.array(*cells))), base


def linear_score(df: DataFrame, weights: dict[str, float], intercept: float = 0.0, out: str = "probability"):
    z = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f).cast("double") for f, w in weights.items()], F.lit(intercept))
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def _reason_map():
    return F.create_map(*[x for f, text in rules.REASON_CODES for x in (F.lit(f), F.lit(text))])


def adverse_action_reasons(arrays: DataFrame, top_n: int = rules.TOP_N_REASONS, toward_denial: str = "positive",
                           long_form: bool = False) -> DataFrame:
    """The ``top_n`` contributions pushing toward denial, as reason text.

    ``toward_denial="positive"``: class 1 means default, so phi > 0 pushes to
    denial (largest first); ``"negative"`` reverses it. Unmapped features get
    a fallback line; the long form adds value / impact and a generic line
    when fewer than ``top_n`` reasons exist."""
    c = F.col("contributions")
    if toward_denial == "positive":
        picked = F.reverse(F.filter(c, lambda x: x["phi"] > 0))
    else:
        picked = F.filter(c, lambda x: x["phi"] < 0)
    # ties on phi: smaller feature name first in both directions
    picked = F.array_sort(picked, lambda a, b: F.when(F.abs(a["phi"]) > F.abs(b["phi"]), -1)
                          .when(F.abs(a["phi"]) < F.abs(b["phi"]), 1)
                          .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    top = F.slice(picked, 1, top_n)
    rmap = _reason_map()

    def text(x):
        known = F.element_at(rmap, x["feature"])
        if long_form:
            detail = F.concat(F.lit(" (Value: "), F.format_string("%.2f", x["value"]),
                              F.lit(", Impact: "), F.format_string("%.4f", x["phi"]), F.lit(")"))
            return F.when(known.isNotNull(), F.concat(known, detail)).otherwise(
                F.concat(F.lit(rules.UNMAPPED_REASON[0]), x["feature"], F.lit(rules.UNMAPPED_REASON[1] + " (Value: "),
                         F.format_string("%.2f", x["value"]), F.lit(")")))
        return F.coalesce(known, F.concat(F.lit(rules.UNMAPPED_REASON[0]), x["feature"], F.lit(rules.UNMAPPED_REASON[1])))

    reasons = F.transform(top, text)
    if long_form:
        reasons = F.when(F.size(reasons) < top_n, F.concat(reasons, F.array(F.lit(rules.GENERIC_REASON)))) \
            .otherwise(reasons)
    return arrays.withColumn("adverse_action_reasons", reasons)


def explanation_records(rows: DataFrame, base_value: float, k: int = 5) -> DataFrame:
    """Base value, all contributions (ascending), 5 most positive, 5 most
    negative, reasons when denied -- for rows that carry contributions and decision."""
    c = F.col("contributions")
    rec = rows.withColumns({
        "base_value": F.lit(base_value),
        "top_positive": F.reverse(F.slice(F.reverse(c), 1, k)),
        "top_negative": F.slice(c, 1, k),
    })
    rec = adverse_action_reasons(rec, long_form=True)
    return rec.withColumn("adverse_action_reasons",
                          F.when(F.col("decision") == "denied", F.col("adverse_action_reasons")))


def batch_explanations(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Decision, probability and the most negative contribution."""
    first = F.element_at(F.col("contributions"), 1)
    return rows.select(key, "decision", "probability", first["feature"].alias("top_negative_feature"),
                       first["phi"].alias("top_negative_impact"))


def global_importance(long: DataFrame, top: int = 20) -> DataFrame:
    """Mean |phi| per feature, largest first (a top-k report)."""
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi")) \
        .orderBy(F.desc("mean_abs_phi"), "feature").limit(top)


def waterfall(rows: DataFrame, base_value: float, key: str = KEY) -> DataFrame:
    """Steps from the base value in |phi| order, summed inside the row."""
    steps = F.array_sort("contributions", lambda a, b: F.when(F.abs(a["phi"]) > F.abs(b["phi"]), -1)
                         .when(F.abs(a["phi"]) < F.abs(b["phi"]), 1).when(a["feature"] < b["feature"], -1)
                         .when(a["feature"] > b["feature"], 1).otherwise(0))
    out = rows.select(key, steps.alias("_s")).select(key, F.posexplode("_s").alias("_i", "_c"), "_s")
    so_far = F.aggregate(F.slice("_s", F.lit(1), F.col("_i") + 1), F.lit(0.0), lambda a, c: a + c["phi"])
    return out.select(key, "_c.feature", "_c.phi", (F.col("_i") + 1).cast("long").alias("step"),
                      (F.lit(base_value) + so_far).alias("cumulative"))


def permutation_shapley(df: DataFrame, model, feature_cols: list[str], background: DataFrame,
                        n_permutations: int = 8, seed: int = 42, key: str = KEY,
                        prob_col: str = "default_probability", n_background: int = 100, others=()) -> DataFrame:
    """G1: model-agnostic Shapley values by permutation sampling (Strumbelj &
    Kononenko 2014), as one Spark job.

    Every row draws ``n_permutations`` feature orders and, for each, one
    background row, all by hash; each pair yields len(features)+1 hybrid rows,
    one ``model.transform`` scores them, and marginal contributions are averaged
    with ``groupBy(key, feature)``. Output grows with rows x permutations x features.
    ``n_background`` bounds the background sample (chosen by hash) that travels as literals;
    columns in ``others`` reach the model with the row's own values and get no share."""
    nf = len(feature_cols)
    doubles = [F.col(c).cast("double").alias(c) for c in feature_cols]
    bg_rows = background.select(*doubles).orderBy(F.xxhash64(*feature_cols, F.lit(seed)), *feature_cols).limit(n_background).collect()
    bg_lit = F.array(*[F.struct(*[F.lit(r[c]).cast("double").alias(f"_b_{c}") for c in feature_cols]) for r in bg_rows])
    others = list(others)
    base = df.select(key, *doubles, *others, F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("_perm"))
    pick = F.pmod(F.xxhash64(F.col(key), F.col("_perm"), F.lit(seed + 1)), F.lit(len(bg_rows))).cast("int")
    base = base.withColumn("_bg", F.get(bg_lit, pick)).select("*", "_bg.*").drop("_bg")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(nf - 1)), lambda i: F.struct(
        F.xxhash64(F.col(key), F.col("_perm"), i, F.lit(seed)).alias("h"), i.alias("i"))))
    base = base.withColumn("_order", F.transform(order, lambda s: s["i"]))
    steps = base.select("*", F.posexplode(F.sequence(F.lit(0), F.lit(nf))).alias("_k", "_dummy"))
    # feature j takes x's value when its position in the order is < k, else the background value
    pos = {c: F.array_position(F.col("_order"), F.lit(j)) - 1 for j, c in enumerate(feature_cols)}
    hybrid = steps.select(key, "_perm", "_k", "_order", *others,
                          *[F.when(pos[c] < F.col("_k"), F.col(c)).otherwise(F.col(f"_b_{c}")).alias(c)
                            for c in feature_cols])
    out = model.transform(hybrid)
    p = F.col(prob_col) if prob_col in out.columns else vector_to_array("probability")[1]
    scored = out.select(key, "_perm", "_k", "_order", p.alias("_p"))
    w = Window.partitionBy(key, "_perm").orderBy("_k")
    marg = scored.withColumn("_delta", F.col("_p") - F.lag("_p").over(w)).filter(F.col("_k") > 0)
    names = F.array(*[F.lit(c) for c in feature_cols])
    marg = marg.withColumn("feature", F.element_at(names, F.element_at(F.col("_order"), F.col("_k")) + 1))
    return marg.groupBy(key, "feature").agg(F.avg("_delta").alias("phi"))
