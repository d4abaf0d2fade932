"""End-to-end jobs composed from the operators.

Each job takes DataFrames and returns DataFrames or a model; where a path is
given it also saves the model or appends to the log. Lineage is cut with
``checkpoint()`` into the cluster's checkpoint folder (never local).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.operators import clean as cl
from lendlens.operators import documents as docs
from lendlens.operators import explain as xp
from lendlens.operators import fairness as fair
from lendlens.operators import features as feat
from lendlens.operators import log as plog
from lendlens.operators import model as mdl
from lendlens.operators import tree_shap as shap
from lendlens.operators.mitigation import constrained_grid, gbt_factory
from lendlens.operators.rank import stratified_split
from lendlens.session import ensure_checkpoint_dir


def nlp_job(statements: DataFrame, key: str = "application_id", vocab_size: int = 100) -> DataFrame:
    """Statement text -> parsed lines -> behavioural features, and the text's
    TF-IDF terms as a map of at most ``vocab_size`` entries per application."""
    features = feat.statement_features(statements, key)
    terms = docs.tfidf_maps(statements.select(key, F.col("statement_text").alias("text")), key, "text", vocab_size)
    return features.join(terms, key, "left")


def with_statement_features(applications: DataFrame, statements: DataFrame | None, key: str) -> DataFrame:
    if statements is None:
        return applications
    return feat.with_transaction_features(applications, feat.transaction_features(feat.parse_transactions(statements, key=key), key), key)


def train_job(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], test_fraction: float = 0.2,
              seed: int = 42, statements: DataFrame | None = None, save_to: str | None = None, trained_at: str | None = None,
              min_rows: int = 100, **gbt_params):
    """dedupe -> statement features -> exact stratified split -> class weights -> fit on train
    only -> evaluate -> save with metadata.

    Of rows with one key the smallest by all other columns stays. Returns (model,
    metrics dict, test DataFrame). Raises when fewer than ``min_rows`` rows are
    available or the label is not binary."""
    ensure_checkpoint_dir(df.sparkSession)
    data = cl.remove_duplicates(df, [key], order_by=[c for c in df.columns if c != key])
    bal = cl.class_balance(data, label).first()
    if bal.negatives + bal.positives < min_rows:
        raise ValueError(f"not enough rows to train: {min_rows} are needed")
    if not bal.is_binary:
        raise ValueError("label must have two classes")
    data = cl.interaction_features(with_statement_features(data, statements, key))
    split = stratified_split(data, key, label, test_fraction, seed).checkpoint()
    train = mdl.class_weight_column(split.filter(F.col("split") == "train"), label)
    test = split.filter(F.col("split") == "test")
    model = mdl.gbt_pipeline(numeric, categorical, label=label, weight_col="weight", seed=seed, **gbt_params) \
        .fit(train)
    metrics = mdl.evaluate(model, test, label)
    if save_to is not None:
        mdl.save_model(model, save_to, {
            "model_type": "GBTClassifier", "trained_at": trained_at, "features": [*numeric, *categorical],
            "n_train": train.count(), "n_test": test.count(), "metrics": {k: float(v) for k, v in metrics.items()},
            "parameters": {k: str(v) for k, v in {"seed": seed, **gbt_params}.items()}})
    return model, metrics, test


def batch_prediction_job(model, applications: DataFrame, columns: list[str], key: str = "application_id",
                         documents: DataFrame | None = None, statements: DataFrame | None = None,
                         background: DataFrame | None = None, log_path: str | None = None, as_of=None,
                         defaults: dict | None = None, n_permutations: int = 8, run_id: str | None = None) -> DataFrame:
    """F16: validate -> document fields and statement features -> align -> score ->
    decide -> reasons for denials -> log.

    Invalid rows come back with their errors and no score. With a ``background``, denied
    rows get adverse-action reasons: from exact tree attributions where the model is a tree ensemble
    and the background has all ``columns``, from sampled Shapley values over the numeric ones otherwise. With ``log_path`` (and ``as_of``, the time of the
    decisions) the scored rows are appended to the prediction log, once however often the job runs under one ``run_id``."""
    valid, bad = cl.split_valid(applications)
    if documents is not None:
        fields = docs.extract_document_fields(documents).groupBy(key).agg(F.max("net_income").alias("verified_net_income"))
        valid = cl.assemble_feature_matrix(valid, fields, key=key)
    valid = cl.interaction_features(with_statement_features(valid, statements, key))
    scored = mdl.batch_score(model, valid, columns, key, defaults)
    if background is not None:
        numeric = [c for c, t in valid.dtypes if c in columns and t not in ("string", "boolean")]
        denied = scored.filter(F.col("decision") == "denied").select(key)
        rows = cl.align_to_columns(valid.join(denied, key, "left_semi"), [key, *columns], defaults)
        if hasattr(model.stages[-1], "treeWeights") and set(columns) <= set(background.columns):
            parts, _ = shap.tree_shapley(rows, model, background, key)
        else:
            phi = xp.permutation_shapley(rows, model, numeric, background, n_permutations, key=key,
                                         others=[c for c in columns if c not in numeric])
            parts = phi.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("phi", "feature"))).alias("contributions"))
        reasons = xp.adverse_action_reasons(parts).select(key, "adverse_action_reasons")
        scored = scored.join(reasons, key, "left")
    if log_path is not None:
        rows = valid.join(scored.select(key, "decision", "default_probability", "confidence",
                                        *[c for c in scored.columns if c == "adverse_action_reasons"]), key)
        rows = rows.withColumns({"timestamp": F.lit(as_of).cast("timestamp_ntz"), "prediction": F.col("decision"),
                                 "probability": F.col("default_probability"), "id": F.xxhash64(key),
                                 "applicant_age": F.col("age") if "age" in rows.columns else F.lit(None),
                                 "applicant_income": F.col("annual_income") if "annual_income" in rows.columns else F.lit(None)})
        if "adverse_action_reasons" in rows.columns:
            rows = rows.withColumn("adverse_action_reasons", F.to_json("adverse_action_reasons"))
        plog.append_log(rows, log_path, run_id)
    return scored.unionByName(bad.select(key, "errors"), allowMissingColumns=True)


def audit_model(model, test: DataFrame, sensitive: list[str], label: str = "label", name: str = "Baseline"):
    """H3: predict -> metrics by group -> summary."""
    pred = mdl.predict(model, test)
    pred = pred.withColumn("prediction", F.col("prediction").cast("int"))
    m = fair.metrics_by_group(pred, sensitive, label=label, model=name)
    return m, fair.fairness_summary(m)


CONSTRAINTS = {"demographic_parity": "demographic_parity_difference", "equalized_odds": "equalized_odds_difference"}


def constrained_search(train: DataFrame, valid: DataFrame, group: str, numeric, categorical, label: str = "label",
                       constraint: str = "demographic_parity", strengths=(0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0),
                       multipliers: tuple[dict, ...] = ({},), threads: int = 2, seed: int = 42, **gbt_params):
    """H5 (re-aimed): a grid of cost-sensitive fits, scored on a validation split; the
    model with the lowest (error + gap of the ``constraint``) wins.

    A candidate weights rows by reweighing^strength times its own multiplier per
    (group, label) -- ``multipliers`` holds dicts {(group, label): factor}, others
    keep 1. At most ``threads`` fits run at once. Returns (model, table of candidates)."""
    if constraint not in CONSTRAINTS:
        raise ValueError(f"unknown constraint: {constraint}")
    ensure_checkpoint_dir(train.sparkSession)
    base = fair.reweighing_weights(train, group, label, "rw").checkpoint()
    grid = [(float(s), m) for m in multipliers for s in strengths]

    def fit(candidate):
        strength, factors = candidate
        weight = F.pow(F.col("rw"), F.lit(strength))
        for (g, y), f in factors.items():
            weight = F.when(F.col(group).eqNullSafe(F.lit(g)) & (F.col(label) == y), weight * f).otherwise(weight)
        fitted = mdl.gbt_pipeline(numeric, categorical, label=label, weight_col="weight", seed=seed, **gbt_params) \
            .fit(base.withColumn("weight", weight))
        m, s = audit_model(fitted, valid, [group], label, name=f"strength={strength}")
        return fitted, 1.0 - m.filter("row_kind = 'overall'").first().accuracy, s.first()[CONSTRAINTS[constraint]]

    with ThreadPoolExecutor(threads) as pool:
        results = list(pool.map(fit, grid))
    best = min(range(len(grid)), key=lambda i: (results[i][1] + results[i][2], i))
    rows = [(s, str(m), constraint, float(e), float(g), i == best) for i, ((s, m), (_, e, g)) in enumerate(zip(grid, results, strict=True))]
    table = train.sparkSession.createDataFrame(
        rows, "strength double, multipliers string, constraint string, error double, gap double, chosen boolean")
    return results[best][0], table


def mitigation_job(train: DataFrame, valid: DataFrame, test: DataFrame, group: str, numeric, categorical, label: str = "label",
                   seed: int = 42, constraint: str = "demographic_parity", strengths=None, grid_size: int = 50, **gbt_params):
    """H3 -> H9 -> H5 -> H6: audit a baseline, search a fairer model only if one is
    needed, and report both on the test rows. Returns (model, before/after report).

    The search is the grid of ``grid_size`` multipliers, or, with ``strengths``, the shorter one of reweighing strengths."""
    baseline = mdl.gbt_pipeline(numeric, categorical, label=label, weight_col="weight", seed=seed, **gbt_params) \
        .fit(mdl.class_weight_column(train, label))
    _, before = audit_model(baseline, test, [group], label)
    chosen = baseline
    if fair.needs_mitigation(before).first().needs_mitigation:
        if strengths is not None:
            chosen, _ = constrained_search(train, valid, group, numeric, categorical, label, constraint, strengths, seed=seed, **gbt_params)
        else:
            chosen, _ = constrained_grid(train, valid, group, gbt_factory(numeric, categorical, seed, **gbt_params), label, constraint, grid_size)
    _, after = audit_model(chosen, test, [group], label, name="Mitigated")
    return chosen, fair.before_after_report(before, after)
