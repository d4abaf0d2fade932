"""Fairness audit: per-group metrics, parity summaries, reweighing, log audit.

Sensitive columns are unpivoted to (sensitive_feature, group) so all
features are measured in one ``rollup`` pass: group rows and each feature's
overall row come out of the same aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions import rules
from lendlens.operators.metrics import rates_from_counts

METRICS = ["accuracy", "precision", "recall", "selection_rate",
           "false_positive_rate", "false_negative_rate", "true_positive_rate"]


def unpivot_sensitive(df: DataFrame, sensitive: list[str], keep: list[str]) -> DataFrame:
    stacked = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in sensitive])
    return stacked.unpivot(keep, sensitive, "sensitive_feature", "group")


def metrics_by_group(df: DataFrame, sensitive: list[str], label: str = "label", pred: str = "prediction",
                     model: str = "Model") -> DataFrame:
    """H1: metrics per (feature, group), and per feature the overall row, the largest
    difference and the smallest ratio (min / max) between groups.

    ``row_kind`` (group, overall, difference, ratio) tells the rows apart, so a
    group may bear any name; a null group is a group of its own."""
    long = unpivot_sensitive(df, sensitive, [label, pred])
    y, p = F.col(label), F.col(pred)
    counts = long.rollup("sensitive_feature", "group").agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    ).filter(F.col("_gid") < 3)
    rates = rates_from_counts(counts).select(
        "sensitive_feature",
        F.when(F.col("_gid") == 1, F.lit("Overall")).otherwise(F.col("group")).alias("group"),
        F.when(F.col("_gid") == 1, F.lit("overall")).otherwise(F.lit("group")).alias("row_kind"),
        F.col("n").alias("sample_size"), *METRICS)
    bounds = rates.filter("row_kind = 'group'").groupBy("sensitive_feature").agg(
        *[F.max(m).alias(f"hi_{m}") for m in METRICS], *[F.min(m).alias(f"lo_{m}") for m in METRICS])
    wide = F.array(
        F.struct(F.lit("Max Difference").alias("group"), F.lit("difference").alias("row_kind"),
                 *[(F.col(f"hi_{m}") - F.col(f"lo_{m}")).alias(m) for m in METRICS]),
        F.struct(F.lit("Min/Max Ratio").alias("group"), F.lit("ratio").alias("row_kind"),
                 *[F.when(F.col(f"hi_{m}") > 0, F.col(f"lo_{m}") / F.col(f"hi_{m}")).alias(m) for m in METRICS]))
    between = bounds.select("sensitive_feature", F.inline(wide)).withColumn("sample_size", F.lit(0).cast("long"))
    out = rates.unionByName(between)
    return out.select(F.lit(model).alias("model"), *out.columns)


def fairness_summary(metrics: DataFrame, threshold: float = rules.FAIRNESS_THRESHOLD) -> DataFrame:
    """H2: demographic-parity and equalized-odds differences per feature, with flags."""
    g = metrics.filter("row_kind = 'group'")
    s = g.groupBy(*[c for c in ("model", "sensitive_feature") if c in g.columns]).agg(
        (F.max("selection_rate") - F.min("selection_rate")).alias("demographic_parity_difference"),
        F.greatest(F.max("true_positive_rate") - F.min("true_positive_rate"),
                   F.max("false_positive_rate") - F.min("false_positive_rate")).alias("equalized_odds_difference"),
    )
    return s.withColumns({
        "is_fair_dp": F.abs("demographic_parity_difference") < threshold,
        "is_fair_eo": F.abs("equalized_odds_difference") < threshold,
    })


def needs_mitigation(summary: DataFrame) -> DataFrame:
    """H9: one row, true when any fairness flag is false."""
    return summary.agg((F.count_if(~F.col("is_fair_dp") | ~F.col("is_fair_eo")) > 0).alias("needs_mitigation"))


def reweighing_weights(df: DataFrame, group: str, label: str = "label", weight_col: str = "weight") -> DataFrame:
    """H4: w = P(g) P(y) / P(g, y) -- Kamiran & Calders reweighing.

    The (group, label) table has one row per combination; AQE turns the
    join into a broadcast at run time when that table is small.
    """
    cells = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n_gy"))
    # windows over the small cell table (one row per group x label)
    w = cells.select(
        group, label,
        (F.sum("n_gy").over(Window.partitionBy(group)) * F.sum("n_gy").over(Window.partitionBy(label))
         / (F.sum("n_gy").over(Window.partitionBy()) * F.col("n_gy"))).alias(weight_col))
    w = w.select(F.col(group).alias("_g"), F.col(label).alias("_y"), weight_col)
    return df.join(w, df[group].eqNullSafe(F.col("_g")) & df[label].eqNullSafe(F.col("_y")), "left").drop("_g", "_y")


def before_after_report(baseline: DataFrame, mitigated: DataFrame) -> DataFrame:
    """H6: per feature and metric, baseline, mitigated and improvement (baseline - mitigated)."""
    def long(s, name):
        return s.select("sensitive_feature",
                        F.col("demographic_parity_difference").alias("Demographic Parity Difference"),
                        F.col("equalized_odds_difference").alias("Equalized Odds Difference")) \
            .unpivot(["sensitive_feature"], ["Demographic Parity Difference", "Equalized Odds Difference"],
                     "metric", name)
    b, m = long(baseline, "baseline"), long(mitigated, "mitigated")
    return b.join(m, ["sensitive_feature", "metric"]).withColumn(
        "improvement", F.col("baseline") - F.col("mitigated"))


def log_fairness_audit(log: DataFrame, as_of, days_back: int = 30, attrs=("gender", "race"),
                       min_rows: int = 10) -> DataFrame:
    """H7: approval rate by each attribute over the last ``days_back`` days of the
    log, the overall rate, and per attribute both parity definitions: the largest
    |group - overall| gap and the largest difference between two groups.

    One grouping-sets aggregate; rows without demographics are excluded. The
    result carries ``enough_data`` (at least ``min_rows`` rows)."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days_back))
    recent = log.filter((F.col("timestamp") >= cutoff)
                        & reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in attrs]))
    approved = (F.col("decision") == "approved").cast("double")
    gs = recent.groupingSets([[a] for a in attrs] + [[]], *attrs).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n"), F.avg(approved).alias("rate"))
    full = (1 << len(attrs)) - 1
    which = F.lit(None).cast("struct<attribute:string,group:string>")
    for i, a in enumerate(attrs):
        which = F.when(F.col("_gid") == full ^ (1 << (len(attrs) - 1 - i)),
                       F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group"))).otherwise(which)
    # windows over the grouping-sets result: one row per attribute value
    everyone, own = Window.partitionBy(), Window.partitionBy("attribute")
    overall = F.col("_gid") == full
    groups = gs.withColumns({
        "overall_rate": F.max(F.when(overall, F.col("rate"))).over(everyone),
        "total": F.max(F.when(overall, F.col("n"))).over(everyone),
        "_a": which,
    }).filter(F.col("_a").isNotNull()).select("_a.attribute", "_a.group", "n", "rate", "overall_rate", "total")
    groups = groups.withColumn("gap_to_overall", F.abs(F.col("rate") - F.col("overall_rate")))
    return groups.withColumns({
        "max_gap_to_overall": F.max("gap_to_overall").over(own),
        "dp_difference": F.max("rate").over(own) - F.min("rate").over(own),
        "enough_data": F.col("total") >= min_rows,
    })


def recommendations(audit: DataFrame, alert: float = rules.DISPARITY_ALERT) -> DataFrame:
    """H8: one line per attribute whose gap exceeds ``alert``, else one all-clear line."""
    per = audit.groupBy("attribute").agg(F.max("max_gap_to_overall").alias("gap"))
    found = F.col("gap") > alert
    everyone = Window.partitionBy()  # one row per attribute
    rows = per.withColumns({"_n": F.count_if(found).over(everyone),
                            "_first": F.col("attribute") == F.min("attribute").over(everyone)}) \
        .filter(found | ((F.col("_n") == 0) & F.col("_first")))
    return rows.select(
        F.when(found, F.col("attribute")).alias("attribute"),
        F.when(found, F.concat(F.initcap("attribute"), F.lit(rules.DISPARITY_TEXT[0]),
                               F.format_number(F.col("gap") * 100, 1), F.lit(rules.DISPARITY_TEXT[1])))
        .otherwise(F.lit(rules.NO_DISPARITY_TEXT)).alias("message"))
