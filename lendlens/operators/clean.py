"""Cleaning and feature preparation over whole tables.

Statistics (means, modes, bounds) are computed in one aggregate per call;
the resulting single row -- one value per column -- is what ``ml.Imputer``
and ``MinMaxScaler`` also bring back, and is fed back as literals.
"""

from __future__ import annotations

import re
from functools import reduce

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.functions import rules
from lendlens.session import ensure_checkpoint_dir

NUMERIC = ("int", "bigint", "smallint", "tinyint", "float", "double")


def identify_feature_types(df: DataFrame, exclude=()) -> tuple[list[str], list[str]]:
    """B1: (numeric, categorical) column names by declared type; booleans,
    dates and timestamps are in neither; ``exclude`` (ids, names, label,
    sensitive attributes) is removed from both."""
    ex = set(exclude)
    num = [c for c, t in df.dtypes if c not in ex and (t in NUMERIC or t.startswith("decimal"))]
    cat = [c for c, t in df.dtypes if c not in ex and t == "string"]
    return num, cat


def clean_column_names(df: DataFrame) -> DataFrame:
    """B2: strip names, replace space, '-' and '.' with '_'; raise on collisions."""
    new = [re.sub(r"[ \-.]", "_", c.strip()) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"column names collide after cleaning: {new}")
    return df.toDF(*new)


def cast_numeric(df: DataFrame, cols) -> DataFrame:
    """Cast listed columns to double; unparsable values become null; unknown names are ignored."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in present})


def remove_duplicates(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    """Keep one row per ``subset``. With ``order_by`` the kept row is the one
    with the smallest ordering value -- a ``min_by`` aggregate (partial
    aggregation, so a hot key never lands whole in one task)."""
    if subset is None or order_by is None:
        return df.dropDuplicates(subset)
    rest = [c for c in df.columns if c not in subset]
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    kept = df.groupBy(*subset).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*subset, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def fill_constants(df: DataFrame, values: dict) -> DataFrame:
    """B5."""
    return df.na.fill(values)


def _modes(df: DataFrame, columns: list[str]) -> dict:
    """{column: most frequent non-null value, the smaller of ties} of all columns, in one pass and one aggregate."""
    if not columns:
        return {}
    kinds = dict(df.dtypes)
    number = [kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") for c in columns]
    cells = [F.struct(F.lit(i).alias("i"), (F.col(c) if n else F.lit(None)).cast("double").alias("number"),
                      (F.lit(None) if n else F.col(c)).cast("string").alias("text")) for i, (c, n) in enumerate(zip(columns, number, strict=True))]
    values = df.select(F.inline(F.array(*cells))).filter("number IS NOT NULL OR text IS NOT NULL") \
        .groupBy("i", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    best = {r["i"]: r["best"] for r in values.groupBy("i").agg(F.min(F.struct(-F.col("n"), "number", "text")).alias("best")).collect()}
    return {c: (best[i]["number"] if n else best[i]["text"]) if i in best else None for i, (c, n) in enumerate(zip(columns, number, strict=True))}


def impute(df: DataFrame, numeric=(), categorical=(), strategy: str = "mean", relative_error: float = 0.001) -> DataFrame:
    """Numeric by mean, median (approximate, bounded memory) or mode,
    categorical by the most frequent non-null value. Modes come from counts per
    value with the smaller value winning ties, summed before the shuffle, for all columns at once."""
    if strategy not in ("mean", "median", "mode"):
        raise ValueError(f"unknown imputation strategy: {strategy}")
    stats = {}
    aggs = [(F.avg(F.col(c).cast("double")) if strategy == "mean" else F.percentile_approx(F.col(c).cast("double"), 0.5, int(1 / relative_error)))
            .alias(c) for c in numeric] if strategy != "mode" else []
    if aggs:
        stats |= df.agg(*aggs).first().asDict()
    stats |= _modes(df, [*categorical, *(numeric if strategy == "mode" else ())])
    if not stats:
        return df
    return df.withColumns({c: F.coalesce(F.col(c).cast("double") if c in numeric else F.col(c), F.lit(stats[c]) if c in numeric else F.lit(stats[c]).cast(df.schema[c].dataType))
                           for c in list(numeric) + list(categorical) if stats[c] is not None})


def iqr_bounds(df: DataFrame, col: str, by=(), k: float = 1.5, exact: bool = False,
               accuracy: int = 10000) -> DataFrame:
    """B8 bounds: q1 - k*IQR, q3 + k*IQR per group (``exact`` uses linear
    interpolation like SQL's percentile_cont; its buffer grows with the number
    of distinct values, so keep it for bounded domains)."""
    x = F.col(col).cast("double")
    q = (F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))) if exact
         else F.percentile_approx(x, [0.25, 0.75], accuracy))
    g = df.groupBy(*by) if by else df.groupBy()
    b = g.agg(q.alias("_q"))
    iqr = b["_q"][1] - b["_q"][0]
    return b.select(*by, (b["_q"][0] - k * iqr).alias("lower_bound"), (b["_q"][1] + k * iqr).alias("upper_bound"))


def filter_outliers(df: DataFrame, col: str, method: str = "iqr", by=(), k: float = 1.5, exact: bool = False,
                    z: float = 3.0) -> DataFrame:
    """Keep rows inside [lower, upper]; bounds per group are a small
    table joined back (AQE broadcasts it when it is small)."""
    if method == "iqr":
        bounds = iqr_bounds(df, col, by, k, exact)
    elif method == "zscore":
        g = df.groupBy(*by) if by else df.groupBy()
        s = g.agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
        bounds = s.select(*by, (F.col("_m") - z * F.col("_s")).alias("lower_bound"),
                          (F.col("_m") + z * F.col("_s")).alias("upper_bound"))
    else:
        raise ValueError(method)
    x = F.col(col)
    if by:
        renamed = bounds.select(*[F.col(c).alias(f"_by_{c}") for c in by], "lower_bound", "upper_bound")
        same = [df[c].eqNullSafe(F.col(f"_by_{c}")) for c in by]
        j = df.join(renamed, reduce(lambda a, b: a & b, same))
    else:
        lo, hi = bounds.first()
        j = df.withColumns({"lower_bound": F.lit(lo), "upper_bound": F.lit(hi)})
    return j.filter((x >= F.col("lower_bound")) & (x <= F.col("upper_bound"))).select(*df.columns)


def scale(df: DataFrame, min_max=(), standard=(), with_mean: bool = True, with_std: bool = True, population: bool = False,
          min_max_suffix: str = "_scaled", standard_suffix: str = "_std") -> DataFrame:
    """B9 and B10 with all statistics from one aggregate: (x - min) / (max - min),
    a constant column maps to 0.5; (x - mean) / std with sample (default) or
    population std, a constant column maps to 0. Nulls stay null."""
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = [f(c).alias(f"{n}_{c}") for c in min_max for n, f in (("min", F.min), ("max", F.max))] \
        + [f(c).alias(f"{n}_{c}") for c in standard for n, f in (("m", F.avg), ("s", sd))]
    if not aggs:
        return df
    st = df.agg(*aggs).first().asDict()
    out = {}
    for c in min_max:
        lo, hi = st[f"min_{c}"], st[f"max_{c}"]
        out[c + min_max_suffix] = F.when(F.col(c).isNotNull(), F.lit(0.5)) if lo == hi else (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    for c in standard:
        e = F.col(c).cast("double")
        if with_mean:
            e = e - F.lit(st[f"m_{c}"])
        if with_std:
            s = st[f"s_{c}"]
            e = e / F.lit(s) if s else F.when(e.isNotNull(), F.lit(0.0))
        out[c + standard_suffix] = e
    return df.withColumns(out)


def min_max_scale(df: DataFrame, cols, suffix: str = "_scaled") -> DataFrame:
    """B9 alone."""
    return scale(df, min_max=cols, min_max_suffix=suffix)


def standard_scale(df: DataFrame, cols, with_mean: bool = True, with_std: bool = True, population: bool = False,
                   suffix: str = "_std") -> DataFrame:
    """B10 alone."""
    return scale(df, standard=cols, with_mean=with_mean, with_std=with_std, population=population, standard_suffix=suffix)


def duplicate_counts(df: DataFrame, subset) -> DataFrame:
    """B4's report: (rows, kept, dropped) of ``remove_duplicates`` over ``subset``, counted per key before the shuffle."""
    per = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("kept")) \
        .withColumn("dropped", F.col("rows") - F.col("kept"))


def invalid_counts(df: DataFrame, cols) -> DataFrame:
    """B12's report: (rows, skipped), the rows that an assembler with ``handleInvalid="skip"`` leaves out --
    those with a null or NaN in any of the numeric ``cols``."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in cols])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("skipped"))


def validate(df: DataFrame, api_rules: bool = True) -> DataFrame:
    """``errors`` (array of messages) and ``is_valid`` for every row."""
    lo_s, hi_s = rules.CREDIT_SCORE_RANGE
    lo_a, hi_a = rules.AGE_RANGE
    text, checks = rules.VALIDATION_TEXT, []
    for f in rules.REQUIRED_FIELDS:
        if f not in df.columns:
            checks.append(F.lit(text["missing"].format(f)))
        else:
            checks.append(F.when(F.col(f).isNull(), F.lit(text["null"].format(f))))

    def message(name, value=None):
        head, _, tail = text[name].partition("{}")
        return F.lit(head) if value is None else F.concat(F.lit(head), value.cast("string"), F.lit(tail))

    for c, name, bad in (("credit_score", "score", lambda x: (x < lo_s) | (x > hi_s)), ("age", "age", lambda x: (x < lo_a) | (x > hi_a)),
                         ("loan_amount", "amount", lambda x: x <= 0)):
        if c in df.columns:
            checks.append(F.when(bad(F.col(c)), message(name, F.col(c))))
    if api_rules:
        for c, name in (("loan_term", "term"), ("annual_income", "income"), ("employment_length", "employment")):
            if c in df.columns:
                checks.append(F.when(F.col(c) <= 0 if c == "loan_term" else F.col(c) < 0, message(name)))
    errors = F.filter(F.array(*checks), lambda e: e.isNotNull())
    return df.withColumns({"errors": errors, "is_valid": F.size(errors) == 0})


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = validate(df)
    return v.filter("is_valid").drop("errors", "is_valid"), v.filter(~F.col("is_valid"))


def _has(df, *cols):
    return all(c in df.columns for c in cols)


def interaction_features(df: DataFrame) -> DataFrame:
    """B18 + B19 + B20: each feature only when its inputs exist; divisions by a
    zero term are null (try_divide)."""
    out = {}
    if _has(df, "loan_amount", "verified_net_income"):
        out["loan_to_income_ratio"] = F.col("loan_amount") / (F.col("verified_net_income") * 12 + 1)
        out["loan_to_verified_income"] = F.col("loan_amount") / (F.col("verified_net_income") * 12 + 1)
    if _has(df, "loan_amount", "loan_term", "verified_net_income"):
        out["payment_to_income_ratio"] = F.try_divide(F.col("loan_amount"), F.col("loan_term")) / (
            F.col("verified_net_income") + 1)
    if _has(df, "credit_score", "risk_flag_count"):
        out["risk_score_composite"] = F.col("credit_score") / (F.col("risk_flag_count") + 1)
        out["credit_risk_interaction"] = F.col("credit_score") / (F.col("risk_flag_count") + 1)
    if _has(df, "income_stability_variance", "months_with_zero_overdraft"):
        out["financial_stability_score"] = F.col("months_with_zero_overdraft") / (F.col("income_stability_variance") + 1)
    if _has(df, "income_stability_variance", "monthly_emi_total", "avg_salary_deposit"):
        out["stability_debt_ratio"] = (F.col("income_stability_variance") + 1) * (
            F.col("monthly_emi_total") / (F.col("avg_salary_deposit") + 1))
    if _has(df, "loan_amount", "annual_income"):
        out["loan_to_annual_income"] = F.try_divide(F.col("loan_amount"), F.col("annual_income"))
    if _has(df, "loan_amount", "loan_term"):
        out["loan_per_term"] = F.try_divide(F.col("loan_amount"), F.col("loan_term"))
    if _has(df, "loan_amount", "loan_term", "annual_income"):
        out["debt_to_income_ratio"] = F.when(
            F.col("annual_income") > 0,
            F.try_divide(F.col("loan_amount"), F.col("loan_term")) / (F.col("annual_income") / 12))
    return df.withColumns(out)


def assemble_feature_matrix(base: DataFrame, *parts: DataFrame, key: str = "application_id") -> DataFrame:
    """Left joins on the key, duplicate non-key columns rejected."""
    seen = set(base.columns)
    out = base
    for p in parts:
        dup = (set(p.columns) - {key}) & seen
        if dup:
            raise ValueError(f"duplicate columns: {sorted(dup)}")
        seen |= set(p.columns)
        out = out.join(p, key, "left")
    return out


def align_to_columns(df: DataFrame, columns, defaults: dict | None = None) -> DataFrame:
    """The model's columns in order; missing ones take a default (0), and so
    do nulls of a present column that has a default of its own."""
    defaults = defaults or {}

    def one(c):
        if c not in df.columns:
            return F.lit(defaults.get(c, 0)).alias(c)
        return F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)

    return df.select([one(c) for c in columns])


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Class counts, imbalance ratio neg/pos and a binary-target check (one row)."""
    y = F.col(label)
    return df.agg(
        F.count_if(y == 0).alias("negatives"), F.count_if(y == 1).alias("positives"),
        F.count_distinct(y).alias("classes"),
    ).withColumns({
        "imbalance_ratio": F.try_divide(F.col("negatives").cast("double"), F.col("positives")),
        "is_binary": F.col("classes") == 2,
    })


def stratified_hash_split(df: DataFrame, key: str, label: str = "label", test_fraction: float = 0.2,
                          seed: int = 42) -> DataFrame:
    """Each class split by its own key hash -- deterministic, no shuffle,
    expected ratio per class; ``rank.stratified_split`` gives the exact ratio."""
    from lendlens.operators.metrics import hash_fraction
    h = hash_fraction(F.concat_ws(":", F.col(key).cast("string"), F.col(label).cast("string")), seed)
    return df.withColumn("split", F.when(h < test_fraction, F.lit("test")).otherwise(F.lit("train")))


def quantiles(df: DataFrame, col: str, probabilities, accuracy: int = 10000, exact: bool = False) -> DataFrame:
    """(probability, value) per asked quantile of one column, nulls left out.

    Approximate with bounded memory by default; ``exact`` interpolates like
    SQL's percentile_cont and keeps every distinct value, for bounded domains."""
    x, ps = F.col(col).cast("double"), [float(p) for p in probabilities]
    values = F.percentile(x, F.array(*[F.lit(p) for p in ps])) if exact else F.percentile_approx(x, ps, accuracy)
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("probability"), values.alias("value"))
    return df.agg(pairs.alias("q")).select(F.inline("q"))


def oversample(df: DataFrame, features: list[str], label: str = "label", k: int = 5, seed: int = 42, block: int = 512) -> DataFrame:
    """Synthetic minority rows until both classes are equal (SMOTE).

    Minority rows are range-partitioned along a fixed random direction and cut
    into blocks of ``block`` neighbours on that line; the ``k`` nearest rows are
    searched inside a block, so the work is linear at every size and a crowded
    region is many blocks. Returns (features..., label, synthetic). A class
    without a neighbour (one row) is repeated as it is; features must not be null."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(n) != 2:
        raise ValueError("label must have two classes")
    minority = min(n, key=lambda c: (n[c], c))
    missing = max(n.values()) - n[minority]
    base = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label), F.lit(False).alias("synthetic"))
    if not missing:
        return base
    each, rest = divmod(missing, n[minority])
    axis = np.random.default_rng(seed).standard_normal(len(features))
    rows = base.filter(F.col(label) == minority).select(*features) \
        .withColumn("_p", sum(F.lit(float(a)) * F.col(c) for a, c in zip(axis, features, strict=True)))
    ensure_checkpoint_dir(df.sparkSession)
    rows = rows.repartitionByRange("_p", *features).sortWithinPartitions("_p", *features).checkpoint()
    # rows are numbered through the partitions: every row yields ``each`` synthetic ones, the first ``rest`` one more
    sizes = {r["p"]: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    before = {p: sum(c for q, c in sizes.items() if q < p) for p in sizes}

    def make(batches):
        at, held, size = before.get(TaskContext.get().partitionId(), 0), [], 0
        for pdf in batches:
            pdf = pdf.assign(_n=each + (np.arange(at, at + len(pdf)) < rest))
            at += len(pdf)
            while len(pdf):
                held.append(pdf.iloc[:block - size])
                size += len(held[-1])
                pdf = pdf.iloc[len(held[-1]):]
                if size == block:
                    yield synthetic(pd.concat(held))
                    held, size = [], 0
        if held:
            yield synthetic(pd.concat(held))

    def synthetic(pdf):
        x, out = pdf[features].to_numpy(), []
        rng = np.random.default_rng([seed, int(abs(x).sum()) % (1 << 32), len(x)])
        d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, :max(1, min(k, len(x) - 1))]
        for i, m in enumerate(pdf["_n"].to_numpy()):
            other = x[near[i, rng.integers(0, near.shape[1], m)]] if len(x) > 1 else np.repeat(x[i:i + 1], m, 0)
            out.append(x[i] + rng.random((m, 1)) * (other - x[i]))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, len(features))), columns=features)

    made = rows.mapInPandas(make, ", ".join(f"`{c}` double" for c in features)) \
        .withColumn(label, F.lit(minority).cast(df.schema[label].dataType)).withColumn("synthetic", F.lit(True))
    return base.unionByName(made)

