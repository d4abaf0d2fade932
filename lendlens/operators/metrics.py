"""Classification metrics, ROC / AUC, decisions and bands -- as aggregates.

All metrics are one ``agg`` of ``count_if`` terms (partial + final
aggregation, a single shuffle of one row per map task). The ROC curve is
built from scores pre-aggregated to distinct values and bucketed, so no
window ever runs over raw rows or over one unpartitioned task of unbounded
size.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions import rules
from lendlens.operators.rank import written


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction", by=()) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def rates_from_counts(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    return df.withColumns({
        "accuracy": _ratio((tp + tn).cast("double"), n),
        "precision": _ratio(tp.cast("double"), tp + fp),
        "recall": _ratio(tp.cast("double"), tp + fn),
        "selection_rate": _ratio((tp + fp).cast("double"), n),
        "false_positive_rate": _ratio(fp.cast("double"), fp + tn),
        "false_negative_rate": _ratio(fn.cast("double"), fn + tp),
        "true_positive_rate": _ratio(tp.cast("double"), tp + fn),
    })


def threshold_metrics(df: DataFrame, label: str = "label", prob: str = "probability",
                      threshold: float = rules.APPROVAL_THRESHOLD) -> DataFrame:
    """F8: precision / recall / F1 of class 1, the confusion matrix, FPR, FNR at a threshold."""
    scored = df.withColumn("_pred", (F.col(prob) >= threshold).cast("int"))
    c = rates_from_counts(confusion_counts(scored, label, "_pred"))
    p, r = F.col("precision"), F.col("recall")
    return c.select(
        F.lit(threshold).alias("threshold"),
        "tn", "fp", "fn", "tp", "precision", "recall",
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1_score"),
        "false_positive_rate", "false_negative_rate", "accuracy",
    )


def classification_summary(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """F7 in aggregate form: accuracy and class-weighted precision / recall / F1."""
    c = confusion_counts(df, label, pred)
    tp, fp, tn, fn, n = (F.col(x) for x in ("tp", "fp", "tn", "fn", "n"))
    p1, r1 = _ratio(tp.cast("double"), tp + fp), _ratio(tp.cast("double"), tp + fn)
    p0, r0 = _ratio(tn.cast("double"), tn + fn), _ratio(tn.cast("double"), tn + fp)
    f1 = F.when(p1 + r1 > 0, 2 * p1 * r1 / (p1 + r1)).otherwise(0.0)
    f0 = F.when(p0 + r0 > 0, 2 * p0 * r0 / (p0 + r0)).otherwise(0.0)
    w1, w0 = (tp + fn) / n, (tn + fp) / n
    return c.select(
        "n",
        ((tp + tn) / n).alias("accuracy"),
        (w1 * p1 + w0 * p0).alias("weighted_precision"),
        (w1 * r1 + w0 * r0).alias("weighted_recall"),
        (w1 * f1 + w0 * f0).alias("weighted_f1"),
    )


def roc_points(df: DataFrame, label: str = "label", score: str = "probability", buckets: int = 256) -> DataFrame:
    """One ROC point per distinct score (threshold, fpr, tpr) plus the
    trapezoid contribution of that step.

    1. groupBy(score) -> (pos, neg) per distinct score (partial aggregation,
       so a hot score is one row);
    2. bucket boundaries are approximate quantiles of the distinct scores, so
       buckets hold about as many scores each whatever their distribution;
       per-bucket totals (at most ``buckets + 1`` rows) get prefix offsets from a
       window over that small table;
    3. cumulative counts inside each bucket come from a window partitioned by
       bucket over distinct scores, then offsets are added.
    Thresholds descend: a point counts rows with score >= threshold. Rows
    without a score are left out.
    """
    y = F.col(label)
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    per = written(per, "scores")  # read for the quantiles, the totals and the points
    marks = per.agg(F.percentile_approx("threshold", [(i + 1) / buckets for i in range(buckets - 1)], 40 * buckets)).first()[0]
    splits = [float("-inf"), *sorted({m for m in marks or [] if m == m and abs(m) != float("inf")}), float("inf")]
    if len(splits) > 2:
        per = Bucketizer(splits=splits, inputCol="threshold", outputCol="bucket", handleInvalid="keep").transform(per)
    else:
        per = per.withColumn("bucket", F.lit(0.0))
    tot = per.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    # descending thresholds: offset = totals of all higher buckets
    w_b = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select("bucket",
                     F.coalesce(F.sum("bp").over(w_b), F.lit(0)).alias("off_p"),
                     F.coalesce(F.sum("bn").over(w_b), F.lit(0)).alias("off_n"),
                     F.sum("bp").over(Window.partitionBy()).alias("P"),
                     F.sum("bn").over(Window.partitionBy()).alias("N"))
    w_in = Window.partitionBy("bucket").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    cum = per.withColumns({"cp": F.sum("pos").over(w_in), "cn": F.sum("neg").over(w_in)})
    pts = cum.join(F.broadcast(tot), "bucket")  # tot has at most buckets + 1 rows
    tpc, fpc = F.col("cp") + F.col("off_p"), F.col("cn") + F.col("off_n")
    P, N = F.col("P"), F.col("N")
    return pts.select(
        "threshold",
        _ratio(fpc.cast("double"), N).alias("fpr"),
        _ratio(tpc.cast("double"), P).alias("tpr"),
        F.when((P > 0) & (N > 0), F.col("neg") * (2 * tpc - F.col("pos")) / (2.0 * P * N))
        .otherwise(F.lit(0.0)).alias("area"),
    )


def auc(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """Area under the ROC curve (ties handled as the trapezoid through them)."""
    return roc_points(df, label, score).agg(F.sum("area").alias("auc"), F.count(F.lit(1)).alias("num_thresholds"))


def decisions(df: DataFrame, prob: str = "probability", approval: float = rules.APPROVAL_THRESHOLD,
              high: float = rules.HIGH_RISK_THRESHOLD, low: float = rules.LOW_RISK_THRESHOLD) -> DataFrame:
    """approved below the approval threshold, with confidence label / score."""
    p = F.col(prob)
    approved = p < approval
    sure = F.when(approved, p < low).otherwise(p > high)
    return df.withColumns({
        "decision": F.when(approved, F.lit("approved")).otherwise(F.lit("denied")),
        "confidence_label": F.when(sure, F.lit("High")).otherwise(F.lit("Medium")),
        "confidence": F.when(sure, F.lit(0.9)).otherwise(F.lit(0.7)),
    })


def risk_band(prob) -> "F.Column":
    """display band of a default probability."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(p < rules.LOW_RISK_THRESHOLD, F.lit("low")).when(p < rules.HIGH_RISK_THRESHOLD, F.lit("medium")) \
        .otherwise(F.lit("high"))


def band_histogram(df: DataFrame, prob: str = "probability") -> DataFrame:
    return df.groupBy(risk_band(prob).alias("risk_band")).agg(
        F.count(F.lit(1)).alias("applications"), F.avg(prob).alias("avg_probability"))


def hash_fraction(key, seed: int = 42):
    """Deterministic uniform [0, 1) from a key: first 8 hex digits of md5."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10) \
        .cast("double") / 4294967296.0


def hash_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Stable train/test assignment from the key's hash (layout independent)."""
    return df.withColumn("split", F.when(hash_fraction(key, seed) < test_fraction, F.lit("test"))
                         .otherwise(F.lit("train")))


def split_rates(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows, positives and default rate per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label)).cast("long").alias("positives"),
        F.avg(F.col(label).cast("double")).alias("default_rate"),
    )
