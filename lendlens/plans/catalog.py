"""Registered queries (one per operator family) and their SQL twins.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
provided tables. ``SQL`` holds, for the same names, an ANSI query that
DuckDB runs on the same Parquet files; column names match one for one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.operators import features as feat
from lendlens.plans.oracle_util import (LINE_CATEGORY, TXN_CATEGORY, DEBIT_FLAG, r, round_doubles, sql_case,
                                        sql_case_int, sql_description, sql_signed_amount)
from lendlens.session import ensure_checkpoint_dir
from lendlens.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Statement lines and line features
# ---------------------------------------------------------------------------
LINE_FEATURE_SQL = f"""
WITH t AS (
  SELECT o_custkey AS application_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         {sql_case(LINE_CATEGORY, 'category')}
  FROM orders)
SELECT application_id,
  {r("sum(CASE WHEN category = 'salary' THEN amount ELSE 0 END)", 'total_salary_deposits')},
  count(*) FILTER (WHERE category = 'salary') AS salary_deposit_count,
  {r("CASE WHEN count(*) FILTER (WHERE category = 'salary') > 0 THEN CAST(sum(amount) FILTER (WHERE category = 'salary') AS DOUBLE) / count(*) FILTER (WHERE category = 'salary') ELSE 0 END", 'avg_salary_deposit')},
  {r("coalesce(stddev_samp(CASE WHEN category = 'salary' THEN amount END), 0)", 'salary_deposit_stddev')},
  {r("sum(CASE WHEN category = 'debt_emi' THEN amount ELSE 0 END)", 'monthly_emi_total')},
  count(*) FILTER (WHERE category = 'debt_emi') AS emi_count,
  {r("sum(CASE WHEN category = 'utility' THEN amount ELSE 0 END)", 'monthly_utility_total')},
  {r("sum(CASE WHEN category = 'rent' THEN amount ELSE 0 END)", 'monthly_rent')},
  count(*) FILTER (WHERE category = 'overdraft') AS overdraft_count,
  count(*) FILTER (WHERE category = 'late_fee') AS late_fee_count,
  count(*) FILTER (WHERE category = 'payday_loan') AS payday_loan_count,
  count(*) FILTER (WHERE category = 'gambling') AS gambling_count,
  {r("sum(CASE WHEN category = 'discretionary' THEN amount ELSE 0 END)", 'discretionary_spending')},
  {r("sum(amount)", 'total_transaction_amount')},
  count(*) AS transaction_count,
  {r("CAST(sum(amount) AS DOUBLE) / count(*)", 'avg_transaction_amount')},
  {r("coalesce(stddev_samp(CASE WHEN category = 'salary' THEN amount END), 0)", 'income_stability_variance')},
  count(*) FILTER (WHERE category IN ('overdraft', 'late_fee', 'payday_loan', 'gambling')) AS risk_flag_count,
  {r('''CASE WHEN sum(CASE WHEN category = 'salary' THEN amount ELSE 0 END) > 0 THEN
       CAST(sum(CASE WHEN category IN ('debt_emi', 'utility', 'rent') THEN amount ELSE 0 END) AS DOUBLE)
       / CAST(sum(CASE WHEN category = 'salary' THEN amount ELSE 0 END) AS DOUBLE) ELSE 0 END''', 'expense_to_income_ratio')},
  {r('''CASE WHEN sum(CASE WHEN category = 'salary' THEN amount ELSE 0 END) > 0 THEN
       CAST(sum(CASE WHEN category = 'discretionary' THEN amount ELSE 0 END) AS DOUBLE)
       / CAST(sum(CASE WHEN category = 'salary' THEN amount ELSE 0 END) AS DOUBLE) ELSE 0 END''', 'discretionary_ratio')}
FROM t GROUP BY application_id
"""


@register("statement_features", LINE_FEATURE_SQL)
def q_statement_features(spark, sf_dir):
    """Flagship: behavioural features per application from raw statement text."""
    return round_doubles(feat.statement_features(tb.statements(spark, sf_dir)))


@register("statement_lines", f"""
SELECT o_custkey AS application_id, {sql_case(LINE_CATEGORY, 'category')},
  {r('o_totalprice', 'amount')}, {sql_case_int(DEBIT_FLAG, 'is_debit')},
  CAST(o_orderdate AS DATE) AS txn_day
FROM orders
""")
def q_statement_lines(spark, sf_dir):
    lines = feat.parse_statement_lines(tb.statements(spark, sf_dir))
    lines = lines.select("application_id", "category", F.col("amount").cast("double").alias("amount"), "is_debit",
                         F.to_date(F.substring("transaction_text", 1, 10), "MM/dd/yyyy").alias("txn_day"))
    return round_doubles(lines)


# ---------------------------------------------------------------------------
# Dated transactions and their features
# ---------------------------------------------------------------------------
@register("parsed_transactions", f"""
SELECT o_custkey AS application_id, CAST(o_orderdate AS DATE) AS txn_date, {sql_description()},
  {r('CASE WHEN ' + ' OR '.join(f"(o_orderpriority = '{p}' AND o_orderstatus = '{s}')" for p, s, _, c in tb.DESCRIPTIONS if c) + ' THEN o_totalprice ELSE -o_totalprice END', 'amount')},
  {sql_case(TXN_CATEGORY, 'category')}
FROM orders
""")
def q_parsed_transactions(spark, sf_dir):
    t = feat.parse_transactions(tb.statements(spark, sf_dir))
    return round_doubles(t.select("application_id", "txn_date", "description",
                                  F.col("amount").cast("double").alias("amount"), "category"))


def txn_feature_sql(r=r):
    return f"""
WITH t AS (
  SELECT o_custkey AS application_id, CAST(o_orderdate AS DATE) AS d, o_orderkey AS seq,
         CAST({sql_signed_amount()[:-len(' AS amount')]} AS DECIMAL(18,2)) AS amount, {sql_case(TXN_CATEGORY, 'category')},
         CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 1 ELSE 0 END AS payday
  FROM orders),
b AS (
  SELECT *, sum(amount) OVER (PARTITION BY application_id ORDER BY d, seq ROWS UNBOUNDED PRECEDING) AS bal
  FROM t),
g AS (
  SELECT application_id, d - lag(d) OVER (PARTITION BY application_id ORDER BY d, seq) AS gap
  FROM t WHERE category = 'Income'),
gs AS (
  SELECT application_id, avg(gap) AS gap_mean, stddev_samp(gap) AS gap_std FROM g GROUP BY application_id),
f AS (
  SELECT application_id,
    coalesce(CAST(sum(amount) FILTER (WHERE category = 'Income') AS DOUBLE) / nullif(count(*) FILTER (WHERE category = 'Income'), 0), 0) AS avg_salary_deposit,
    coalesce(stddev_samp(amount) FILTER (WHERE category = 'Income'), 0) AS income_stability_variance,
    count(*) FILTER (WHERE category = 'Income') AS num_income_deposits,
    CAST(abs(coalesce(sum(amount) FILTER (WHERE category = 'Debt_EMI'), 0)) AS DOUBLE) AS monthly_emi_total,
    count(*) FILTER (WHERE category = 'Debt_EMI') AS num_debt_payments,
    coalesce(CAST(sum(amount) FILTER (WHERE category = 'Debt_EMI') AS DOUBLE) / nullif(count(*) FILTER (WHERE category = 'Debt_EMI'), 0), 0) AS avg_debt_payment,
    CAST(abs(coalesce(sum(amount) FILTER (WHERE category = 'Discretionary'), 0)) AS DOUBLE) AS avg_discretionary_spend,
    CAST(abs(coalesce(sum(amount) FILTER (WHERE category = 'Utility'), 0)) AS DOUBLE) AS avg_utility_spend,
    count(*) FILTER (WHERE category = 'Discretionary') AS num_discretionary_txns,
    count(*) FILTER (WHERE category = 'Risk_Flag') AS risk_flag_count,
    CAST(sum(bal) AS DOUBLE) / count(*) AS avg_daily_balance,
    min(bal) AS min_balance,
    count(DISTINCT date_trunc('month', d)) - count(DISTINCT CASE WHEN category = 'Risk_Flag' THEN date_trunc('month', d) END)
      AS months_with_zero_overdraft,
    max(payday) AS relies_on_payday_loans,
    count(*) AS num_transactions,
    max(d) - min(d) AS statement_date_range_days
  FROM b GROUP BY application_id)
SELECT f.application_id,
  {r('avg_salary_deposit', 'avg_salary_deposit')},
  {r('income_stability_variance', 'income_stability_variance')},
  {r('coalesce(gs.gap_mean, 0)', 'days_between_paychecks_mean')},
  {r('coalesce(gs.gap_std, 0)', 'days_between_paychecks_std')},
  num_income_deposits,
  {r('monthly_emi_total', 'monthly_emi_total')},
  num_debt_payments,
  {r('avg_debt_payment', 'avg_debt_payment')},
  {r('avg_discretionary_spend', 'avg_discretionary_spend')},
  {r('avg_utility_spend', 'avg_utility_spend')},
  num_discretionary_txns, risk_flag_count,
  {r('avg_daily_balance', 'avg_daily_balance')},
  {r('min_balance', 'min_balance')},
  CAST(months_with_zero_overdraft AS BIGINT) AS months_with_zero_overdraft,
  relies_on_payday_loans,
  num_transactions,
  CAST(statement_date_range_days AS INTEGER) AS statement_date_range_days,
  {r('(monthly_emi_total + avg_discretionary_spend) / CASE WHEN avg_salary_deposit = 0 THEN 1 ELSE avg_salary_deposit END', 'utilization_ratio_proxy')},
  {r('(months_with_zero_overdraft * 10 - risk_flag_count * 5) + avg_daily_balance / 100', 'financial_health_score')}
FROM f LEFT JOIN gs ON f.application_id = gs.application_id
"""

TXN_FEATURE_SQL = txn_feature_sql()



@register("transaction_features", TXN_FEATURE_SQL)
def q_transaction_features(spark, sf_dir):
    t = feat.parse_transactions(tb.statements(spark, sf_dir))
    return round_doubles(feat.transaction_features(t))


# ---------------------------------------------------------------------------
# Metrics on the scored population
# ---------------------------------------------------------------------------
from lendlens.operators import metrics as met  # noqa: E402
from lendlens.operators import fairness as fair  # noqa: E402
from lendlens.operators import log as plog  # noqa: E402

SCORED_SQL = """s AS (
  SELECT l.doc_id AS application_id, 1 - l.quality AS label,
         CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2000.0) AS probability,
         CASE WHEN CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2000.0) >= 0.5 THEN 1 ELSE 0 END
           AS prediction,
         d.lang, d.source, l.toxic, d.n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

COUNTS_SQL = """c AS (
  SELECT count(*) AS n,
    count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn
  FROM s)"""


def _scored(spark, sf_dir):
    s = tb.scored_population(spark, sf_dir)
    return s.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def _div(a, b):
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"


@register("threshold_metrics", f"""
WITH {SCORED_SQL}, {COUNTS_SQL},
m AS (SELECT *, {_div('tp', 'tp + fp')} AS p, {_div('tp', 'tp + fn')} AS r FROM c)
SELECT CAST(0.5 AS DOUBLE) AS threshold, tn, fp, fn, tp,
  {r('p', 'precision')}, {r('r', 'recall')},
  {r('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END', 'f1_score')},
  {r(_div('fp', 'fp + tn'), 'false_positive_rate')}, {r(_div('fn', 'fn + tp'), 'false_negative_rate')},
  {r(_div('tp + tn', 'n'), 'accuracy')}
FROM m
""")
def q_threshold_metrics(spark, sf_dir):
    return round_doubles(met.threshold_metrics(tb.scored_population(spark, sf_dir)))


@register("classification_summary", f"""
WITH {SCORED_SQL}, {COUNTS_SQL},
m AS (SELECT *, {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1,
             {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0,
             (tp + fn) / n AS w1, (tn + fp) / n AS w0 FROM c),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1,
                CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0 FROM m)
SELECT n, {r('(tp + tn) / n', 'accuracy')}, {r('w1 * p1 + w0 * p0', 'weighted_precision')},
  {r('w1 * r1 + w0 * r0', 'weighted_recall')}, {r('w1 * f1 + w0 * f0', 'weighted_f1')}
FROM f
""")
def q_classification_summary(spark, sf_dir):
    return round_doubles(met.classification_summary(_scored(spark, sf_dir)))


ROC_SQL = f"""
WITH {SCORED_SQL},
per AS (SELECT probability AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
               count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY probability),
cum AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cp,
                  sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cn,
                  sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM per)
"""


@register("roc_curve", ROC_SQL + f"""
SELECT {r('threshold', 'threshold')}, {r(_div('cn', 'N'), 'fpr')}, {r(_div('cp', 'P'), 'tpr')},
  {r('CASE WHEN P > 0 AND N > 0 THEN CAST(neg * (2 * cp - pos) AS DOUBLE) / (2.0 * CAST(P AS DOUBLE) * CAST(N AS DOUBLE)) ELSE 0.0 END', 'area')}
FROM cum
""")
def q_roc_curve(spark, sf_dir):
    return round_doubles(met.roc_points(tb.scored_population(spark, sf_dir)))


@register("auc", ROC_SQL + f"""
SELECT {r('sum(CASE WHEN P > 0 AND N > 0 THEN CAST(neg * (2 * cp - pos) AS DOUBLE) / (2.0 * CAST(P AS DOUBLE) * CAST(N AS DOUBLE)) ELSE 0.0 END)', 'auc')},
  count(*) AS num_thresholds
FROM cum
""")
def q_auc(spark, sf_dir):
    return round_doubles(met.auc(tb.scored_population(spark, sf_dir)))


@register("confusion_counts", f"""
WITH {SCORED_SQL}
SELECT label, prediction, count(*) AS n FROM s GROUP BY label, prediction
""")
def q_confusion_counts(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@register("split_rates", f"""
WITH {SCORED_SQL},
h AS (SELECT *, CASE WHEN CAST(('0x' || substr(md5(CAST(application_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT)
                     / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM s)
SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, {r('avg(label)', 'default_rate')}
FROM h GROUP BY split
""")
def q_split_rates(spark, sf_dir):
    return round_doubles(met.split_rates(met.hash_split(tb.scored_population(spark, sf_dir), "application_id")))


# ---------------------------------------------------------------------------
# Fairness (H1, H2, H4, H9)
# ---------------------------------------------------------------------------
def _group_metric_sql(feature_col: str, src: str = "s") -> str:
    return f"""
  SELECT '{feature_col}' AS sensitive_feature, CAST({feature_col} AS VARCHAR) AS grp, count(*) AS n,
    count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn
  FROM {src} GROUP BY {feature_col}
  UNION ALL
  SELECT '{feature_col}', 'Overall', count(*),
    count(*) FILTER (WHERE label = 1 AND prediction = 1), count(*) FILTER (WHERE label = 0 AND prediction = 1),
    count(*) FILTER (WHERE label = 0 AND prediction = 0), count(*) FILTER (WHERE label = 1 AND prediction = 0)
  FROM {src}"""


FAIR_METRICS_SQL = f"""
WITH {SCORED_SQL},
g AS ({_group_metric_sql('lang')} UNION ALL {_group_metric_sql('source')}),
m AS (SELECT sensitive_feature, grp, n,
  {_div('tp + tn', 'n')} AS accuracy, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall,
  {_div('tp + fp', 'n')} AS selection_rate, {_div('fp', 'fp + tn')} AS false_positive_rate,
  {_div('fn', 'fn + tp')} AS false_negative_rate, {_div('tp', 'tp + fn')} AS true_positive_rate FROM g),
d AS (SELECT sensitive_feature, 'Max Difference' AS grp, CAST(0 AS BIGINT) AS n,
  max(accuracy) - min(accuracy) AS accuracy, max(precision) - min(precision) AS precision,
  max(recall) - min(recall) AS recall, max(selection_rate) - min(selection_rate) AS selection_rate,
  max(false_positive_rate) - min(false_positive_rate) AS false_positive_rate,
  max(false_negative_rate) - min(false_negative_rate) AS false_negative_rate,
  max(true_positive_rate) - min(true_positive_rate) AS true_positive_rate
  FROM m WHERE grp <> 'Overall' GROUP BY sensitive_feature),
q AS (SELECT sensitive_feature, 'Min/Max Ratio' AS grp, CAST(0 AS BIGINT) AS n,
  min(accuracy) / nullif(max(accuracy), 0) AS accuracy, min(precision) / nullif(max(precision), 0) AS precision,
  min(recall) / nullif(max(recall), 0) AS recall, min(selection_rate) / nullif(max(selection_rate), 0) AS selection_rate,
  min(false_positive_rate) / nullif(max(false_positive_rate), 0) AS false_positive_rate,
  min(false_negative_rate) / nullif(max(false_negative_rate), 0) AS false_negative_rate,
  min(true_positive_rate) / nullif(max(true_positive_rate), 0) AS true_positive_rate
  FROM m WHERE grp <> 'Overall' GROUP BY sensitive_feature),
a AS (SELECT * FROM m UNION ALL SELECT * FROM d UNION ALL SELECT * FROM q)
"""


@register("fairness_metrics", FAIR_METRICS_SQL + f"""
SELECT 'Baseline' AS model, sensitive_feature, grp AS "group", n AS sample_size,
  CASE grp WHEN 'Overall' THEN 'overall' WHEN 'Max Difference' THEN 'difference' WHEN 'Min/Max Ratio' THEN 'ratio' ELSE 'group' END AS row_kind,
  {r('accuracy', 'accuracy')}, {r('precision', 'precision')}, {r('recall', 'recall')},
  {r('selection_rate', 'selection_rate')}, {r('false_positive_rate', 'false_positive_rate')},
  {r('false_negative_rate', 'false_negative_rate')}, {r('true_positive_rate', 'true_positive_rate')}
FROM a
""")
def q_fairness_metrics(spark, sf_dir):
    return round_doubles(fair.metrics_by_group(_scored(spark, sf_dir), ["lang", "source"], model="Baseline"))


SUMMARY_SQL = FAIR_METRICS_SQL + """,
su AS (SELECT sensitive_feature, max(selection_rate) - min(selection_rate) AS dp,
  greatest(max(true_positive_rate) - min(true_positive_rate), max(false_positive_rate) - min(false_positive_rate)) AS eo
  FROM m WHERE grp <> 'Overall' GROUP BY sensitive_feature)
"""


@register("fairness_summary", SUMMARY_SQL + f"""
SELECT 'Baseline' AS model, sensitive_feature, {r('dp', 'demographic_parity_difference')},
  {r('eo', 'equalized_odds_difference')}, abs(dp) < 0.05 AS is_fair_dp, abs(eo) < 0.05 AS is_fair_eo
FROM su
""")
def q_fairness_summary(spark, sf_dir):
    m = fair.metrics_by_group(_scored(spark, sf_dir), ["lang", "source"], model="Baseline")
    return round_doubles(fair.fairness_summary(m))


@register("needs_mitigation", SUMMARY_SQL + """
SELECT count(*) FILTER (WHERE NOT (abs(dp) < 0.05) OR NOT (abs(eo) < 0.05)) > 0 AS needs_mitigation FROM su
""")
def q_needs_mitigation(spark, sf_dir):
    m = fair.metrics_by_group(_scored(spark, sf_dir), ["lang", "source"], model="Baseline")
    return fair.needs_mitigation(fair.fairness_summary(m))


@register("reweighing", f"""
WITH {SCORED_SQL},
cells AS (SELECT lang, label, count(*) AS n_gy FROM s GROUP BY lang, label),
w AS (SELECT lang, label, CAST(sum(n_gy) OVER (PARTITION BY lang) * sum(n_gy) OVER (PARTITION BY label) AS DOUBLE)
      / (CAST(sum(n_gy) OVER () * n_gy AS DOUBLE)) AS weight FROM cells)
SELECT s.application_id, s.lang, s.label, {r('w.weight', 'weight')}
FROM s JOIN w ON s.lang = w.lang AND s.label = w.label
""")
def q_reweighing(spark, sf_dir):
    s = tb.scored_population(spark, sf_dir).select("application_id", "lang", "label")
    return round_doubles(fair.reweighing_weights(s, "lang").select("application_id", "lang", "label", "weight"))


# ---------------------------------------------------------------------------
# Prediction log
# ---------------------------------------------------------------------------
AS_OF = "2024-01-30 00:00:00"

LOG_SQL = """lg0 AS (
  SELECT e.event_id AS id, 'APP' || lpad(CAST(e.event_id AS VARCHAR), 8, '0') AS application_id,
         e.ts AS "timestamp", e.event_type AS submitted_by, c.c_name AS applicant_name,
         c.c_mktsegment AS gender, r.r_name AS race, e.value * 100 AS loan_amount,
         least(e.value / 500.0, 1.0) AS probability
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
       LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
       LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
lg AS (
  SELECT *, CASE WHEN probability < 0.5 THEN 'approved' ELSE 'denied' END AS decision,
         CASE WHEN CASE WHEN probability < 0.5 THEN probability < 0.3 ELSE probability > 0.7 END
              THEN 'High' ELSE 'Medium' END AS confidence_label,
         CASE WHEN CASE WHEN probability < 0.5 THEN probability < 0.3 ELSE probability > 0.7 END
              THEN 0.9 ELSE 0.7 END AS confidence
  FROM lg0)"""


def log_rows(spark, sf_dir):
    return met.decisions(tb.prediction_log(spark, sf_dir).withColumn("loan_amount", F.col("loan_amount")))


@register("log_decisions", f"""
WITH {LOG_SQL}
SELECT id, decision, confidence_label, CAST(confidence AS DOUBLE) AS confidence FROM lg
""")
def q_log_decisions(spark, sf_dir):
    return log_rows(spark, sf_dir).select("id", "decision", "confidence_label", "confidence")


@register("risk_bands", f"""
WITH {LOG_SQL}
SELECT CASE WHEN probability < 0.3 THEN 'low' WHEN probability < 0.7 THEN 'medium' ELSE 'high' END AS risk_band,
  count(*) AS applications, {r('avg(probability)', 'avg_probability')}
FROM lg GROUP BY 1
""")
def q_risk_bands(spark, sf_dir):
    return round_doubles(met.band_histogram(log_rows(spark, sf_dir)))


@register("log_page", f"""
WITH {LOG_SQL}
SELECT id, application_id, "timestamp", applicant_name, decision, {r('probability', 'probability')}
FROM lg WHERE decision = 'denied' AND (applicant_name ILIKE '%0001%' OR application_id ILIKE '%0001%')
ORDER BY "timestamp" DESC, id DESC LIMIT 50 OFFSET 5
""")
def q_log_page(spark, sf_dir):
    page = plog.log_page(log_rows(spark, sf_dir), decision="denied", text="0001", offset=5, limit=50)
    return round_doubles(page.select("id", "application_id", "timestamp", "applicant_name", "decision", "probability"))


@register("log_total", f"""
WITH {LOG_SQL}
SELECT count(*) AS total FROM lg
WHERE decision = 'denied' AND (applicant_name ILIKE '%0001%' OR application_id ILIKE '%0001%')
""")
def q_log_total(spark, sf_dir):
    return plog.log_total(log_rows(spark, sf_dir), decision="denied", text="0001")


@register("most_recent", f"""
WITH {LOG_SQL}
SELECT id, application_id, "timestamp", decision FROM lg ORDER BY "timestamp" DESC, id DESC LIMIT 50
""")
def q_most_recent(spark, sf_dir):
    return plog.most_recent(log_rows(spark, sf_dir), 50).select("id", "application_id", "timestamp", "decision")


@register("latest_prediction", f"""
WITH {LOG_SQL}
SELECT max("timestamp") AS last_prediction_time, arg_max(id, ("timestamp", id)) AS last_id FROM lg
""")
def q_latest_prediction(spark, sf_dir):
    return plog.latest(log_rows(spark, sf_dir))


@register("operating_stats", f"""
WITH {LOG_SQL},
a AS (SELECT count(*) AS total_predictions,
  count(*) FILTER (WHERE "timestamp" >= date_trunc('day', TIMESTAMP '{AS_OF}')) AS predictions_today,
  count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS predictions_this_week,
  count(*) FILTER (WHERE decision = 'approved') AS approved,
  avg(loan_amount) AS avg_amount, max("timestamp") AS last_prediction_time FROM lg)
SELECT total_predictions, predictions_today, predictions_this_week,
  CASE WHEN total_predictions > 0 THEN round(approved * 100.0 / total_predictions, 2) END AS approval_rate,
  CASE WHEN total_predictions > 0 THEN round(100.0 - approved * 100.0 / total_predictions, 2) END AS denial_rate,
  round(coalesce(avg_amount, 0.0), 2) AS avg_loan_amount, last_prediction_time
FROM a
""")
def q_operating_stats(spark, sf_dir):
    return plog.operating_stats(log_rows(spark, sf_dir), AS_OF)


AUDIT_SQL = f"""
WITH {LOG_SQL},
rc AS (SELECT * FROM lg WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
       AND gender IS NOT NULL AND race IS NOT NULL),
ov AS (SELECT avg(CASE WHEN decision = 'approved' THEN 1.0 ELSE 0.0 END) AS overall_rate, count(*) AS total FROM rc),
grp AS (
  SELECT 'gender' AS attribute, gender AS "group", count(*) AS n,
         avg(CASE WHEN decision = 'approved' THEN 1.0 ELSE 0.0 END) AS rate FROM rc GROUP BY gender
  UNION ALL
  SELECT 'race', race, count(*), avg(CASE WHEN decision = 'approved' THEN 1.0 ELSE 0.0 END) FROM rc GROUP BY race),
j AS (SELECT grp.*, ov.overall_rate, ov.total, abs(rate - overall_rate) AS gap FROM grp, ov),
au AS (SELECT j.*, max(gap) OVER (PARTITION BY attribute) AS max_gap,
         max(rate) OVER (PARTITION BY attribute) - min(rate) OVER (PARTITION BY attribute) AS dp FROM j)
"""


@register("log_fairness_audit", AUDIT_SQL + f"""
SELECT attribute, "group", n, {r('rate', 'rate')}, {r('overall_rate', 'overall_rate')}, total,
  {r('gap', 'gap_to_overall')}, {r('max_gap', 'max_gap_to_overall')}, {r('dp', 'dp_difference')}, total >= 10 AS enough_data
FROM au
""")
def q_log_fairness_audit(spark, sf_dir):
    return round_doubles(fair.log_fairness_audit(log_rows(spark, sf_dir), AS_OF, days_back=7))


def recommendation_sql(alert: float) -> str:
    return AUDIT_SQL + f""",
per AS (SELECT DISTINCT attribute, max_gap FROM au)
SELECT attribute, upper(substr(attribute, 1, 1)) || substr(attribute, 2) || ' disparity detected: '
       || printf('%.1f', max_gap * 100) || '% difference in approval rates. Consider bias mitigation techniques.'
       AS message
FROM per WHERE max_gap > {alert}
UNION ALL
SELECT NULL, 'No significant fairness issues detected in the specified metrics.'
FROM (SELECT count(*) FILTER (WHERE max_gap > {alert}) AS k FROM per) WHERE k = 0
"""


@register("fairness_recommendations", recommendation_sql(0.1))
def q_fairness_recommendations(spark, sf_dir):
    return fair.recommendations(fair.log_fairness_audit(log_rows(spark, sf_dir), AS_OF, days_back=7))


REQUESTED_IDS_SQL = """ids AS (
  SELECT DISTINCT 'APP' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS application_id
  FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _requested_ids(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return o.select(F.concat(F.lit("APP"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
                    .alias("application_id"))


@register("log_lookup", f"""
WITH {LOG_SQL}, {REQUESTED_IDS_SQL}
SELECT id, application_id, decision FROM lg WHERE application_id IN (SELECT application_id FROM ids)
""")
def q_log_lookup(spark, sf_dir):
    return plog.lookup(log_rows(spark, sf_dir), _requested_ids(spark, sf_dir)).select("id", "application_id", "decision")


@register("missing_predictions", f"""
WITH {LOG_SQL}, {REQUESTED_IDS_SQL}
SELECT application_id FROM ids WHERE application_id NOT IN (SELECT application_id FROM lg)
""")
def q_missing_predictions(spark, sf_dir):
    return plog.missing(_requested_ids(spark, sf_dir), log_rows(spark, sf_dir))


# ---------------------------------------------------------------------------
# Documents
# ---------------------------------------------------------------------------
from lendlens.operators import documents as docs_op  # noqa: E402
from lendlens.functions import text as T  # noqa: E402


@register("document_fields", f"""
SELECT o_orderkey AS document_id, o_custkey AS application_id,
  CASE o_orderstatus WHEN 'F' THEN 'paystub' WHEN 'O' THEN 'bank_statement' ELSE 'letter' END AS document_type,
  CASE WHEN o_orderstatus = 'F' THEN {r('round(o_totalprice * 0.8, 2)', 'x')[:-5]} END AS net_income,
  CASE WHEN o_orderstatus = 'F' THEN {r('o_totalprice', 'x')[:-5]} END AS gross_income,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%m/%d/%Y') END AS pay_period_start,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 14 DAY, '%m/%d/%Y') END AS pay_period_end,
  CASE WHEN o_orderstatus = 'O' THEN {r('o_totalprice', 'x')[:-5]} END AS account_balance,
  CASE WHEN o_orderstatus = 'O' THEN
    ['Chase', 'Bank of America', 'Wells Fargo', 'Citibank', 'US Bank', 'TD Bank', 'Capital One'][o_custkey % 7 + 1]
  END AS bank_name
FROM orders
""")
def q_document_fields(spark, sf_dir):
    d = docs_op.extract_document_fields(tb.income_documents(spark, sf_dir))
    return round_doubles(d.drop("raw_text"))


from lendlens.functions import rules as RULES  # noqa: E402

DATE_RE = RULES.DATE_TOKEN


@register("document_dates", f"""
SELECT doc_id, len(regexp_extract_all(text, '{DATE_RE}')) AS n_dates,
  array_to_string(regexp_extract_all(text, '{DATE_RE}'), ',') AS dates
FROM documents
""")
def q_document_dates(spark, sf_dir):
    d = docs_op.document_dates(tb.table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.size("dates").cast("long").alias("n_dates"), F.concat_ws(",", "dates").alias("dates"))


@register("clean_text", r"""
SELECT doc_id, coalesce(trim(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'),
                                            '[^a-zA-Z0-9 \t\n\x0B\f\r$.,\-/]', '', 'g')), '') AS clean_text
FROM documents
""")
def q_clean_text(spark, sf_dir):
    return docs_op.clean_documents(tb.table(spark, sf_dir, "documents")).select("doc_id", "clean_text")


@register("parse_values", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed_date, round(o_totalprice, 2) AS parsed_amount
FROM orders
""")
def q_parse_values(spark, sf_dir):
    o = tb.table(spark, sf_dir, "orders")
    fmt = F.pmod(F.col("o_orderkey"), F.lit(3))
    date_text = (F.when(fmt == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
                 .when(fmt == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
                 .otherwise(F.date_format("o_orderdate", "MMM dd, yyyy")))
    money = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return round_doubles(o.select("o_orderkey", T.parse_date(date_text).alias("parsed_date"),
                                  T.parse_currency(money).alias("parsed_amount")), 2)


def _stop_sql() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in docs_op.default_stop_words()) + "]"


@register("tfidf_terms", f"""
WITH tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\W+')) AS term FROM documents),
t AS (SELECT * FROM tok WHERE term <> '' AND NOT list_contains({_stop_sql()}, term)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
vocab AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 100),
n AS (SELECT count(*) AS n_docs FROM documents)
SELECT tf.doc_id, tf.term, tf.tf, {r('tf.tf * ln((n.n_docs + 1.0) / (vocab.df + 1.0))', 'tfidf')}
FROM tf JOIN vocab ON tf.term = vocab.term, n
""")
def q_tfidf_terms(spark, sf_dir):
    return round_doubles(docs_op.tfidf(tb.table(spark, sf_dir, "documents"), vocab_size=100))


@register("tfidf_ngrams", f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                      lambda x: NOT list_contains({_stop_sql()}, x)) AS k FROM documents),
g AS (SELECT doc_id, list_concat(k, CASE WHEN len(k) >= 2 THEN
        list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]) ELSE [] END) AS terms FROM w),
t AS (SELECT doc_id, unnest(terms) AS term FROM g),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
vocab AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 50),
n AS (SELECT count(*) AS n_docs FROM documents),
raw AS (SELECT tf.doc_id, tf.term, tf.tf, tf.tf * (ln((n.n_docs + 1.0) / (vocab.df + 1.0)) + 1.0) AS w
        FROM tf JOIN vocab ON tf.term = vocab.term, n)
SELECT doc_id, term, tf, {r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 'tfidf')} FROM raw
""")
def q_tfidf_ngrams(spark, sf_dir):
    return round_doubles(docs_op.tfidf_ngrams(tb.table(spark, sf_dir, "documents"), max_features=50))


# ---------------------------------------------------------------------------
# Cleaning and feature matrix
# ---------------------------------------------------------------------------
from lendlens.operators import clean as cl  # noqa: E402

APPS_SQL = """apps AS (
  SELECT c.c_custkey AS application_id, c.c_name AS applicant_name, n.n_name AS nation,
    c.c_mktsegment AS segment, c.c_acctbal AS avg_monthly_balance,
    CAST(300 + (c.c_custkey * 7919) % 600 AS INTEGER) AS credit_score,
    CAST(16 + (c.c_custkey * 31) % 60 AS INTEGER) AS age,
    CASE WHEN c.c_acctbal >= 0 THEN round(c.c_acctbal / 1000, 2) END AS employment_length,
    round(coalesce(t.max_order, 0.0) / 10, 2) AS loan_amount,
    [36, 60, 84, 120][c.c_custkey % 4 + 1] AS loan_term,
    round(coalesce(t.total_ordered, 0.0) / 20, 2) AS annual_income
  FROM customer c
  LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS max_order, sum(o_totalprice) AS total_ordered
             FROM orders GROUP BY o_custkey) t ON c.c_custkey = t.o_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


@register("dedupe_customers", """
SELECT c_nationkey, c_mktsegment, c_custkey, c_name, c_acctbal FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1
""")
def q_dedupe_customers(spark, sf_dir):
    c = tb.table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name", "c_acctbal")
    return cl.remove_duplicates(c, ["c_nationkey", "c_mktsegment"], order_by="c_custkey")


@register("lineitem_outliers", """
WITH b AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3
           FROM lineitem GROUP BY l_returnflag)
SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_quantity
FROM lineitem l JOIN b ON l.l_returnflag = b.l_returnflag
WHERE l.l_quantity >= q1 - 1.5 * (q3 - q1) AND l.l_quantity <= q3 + 1.5 * (q3 - q1)
""")
def q_lineitem_outliers(spark, sf_dir):
    li = tb.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    # l_quantity has a bounded domain, so the exact percentile buffer stays small
    return cl.filter_outliers(li, "l_quantity", by=["l_returnflag"], exact=True)


@register("validation", f"""
WITH {APPS_SQL},
e AS (SELECT application_id, list_filter([
    CASE WHEN credit_score < 300 OR credit_score > 850
         THEN 'Credit score ' || CAST(credit_score AS VARCHAR) || ' out of valid range [300, 850]' END,
    CASE WHEN age < 18 OR age > 100 THEN 'Age ' || CAST(age AS VARCHAR) || ' out of valid range [18, 100]' END,
    CASE WHEN loan_amount <= 0 THEN 'Loan amount must be positive, got ' || CAST(loan_amount AS VARCHAR) END,
    CASE WHEN loan_term <= 0 THEN 'Loan term must be positive' END,
    CASE WHEN annual_income < 0 THEN 'Annual income must be non-negative' END,
    CASE WHEN employment_length < 0 THEN 'Employment length must be non-negative' END
  ], lambda x: x IS NOT NULL) AS errs FROM apps)
SELECT application_id, len(errs) = 0 AS is_valid, array_to_string(errs, '; ') AS errors FROM e
""")
def q_validation(spark, sf_dir):
    v = cl.validate(tb.applications(spark, sf_dir))
    return v.select("application_id", "is_valid", F.concat_ws("; ", "errors").alias("errors"))


@register("imputed_applications", f"""
WITH {APPS_SQL}
SELECT application_id, {r('coalesce(employment_length, avg(employment_length) OVER ())', 'employment_length')}
FROM apps
""")
def q_imputed_applications(spark, sf_dir):
    a = tb.applications(spark, sf_dir).select("application_id", "employment_length")
    return round_doubles(cl.impute(a, numeric=["employment_length"], strategy="mean"))


@register("scaled_applications", f"""
WITH {APPS_SQL}
SELECT application_id,
  {r('CAST(credit_score - min(credit_score) OVER () AS DOUBLE) / (max(credit_score) OVER () - min(credit_score) OVER ())', 'credit_score_scaled')},
  {r('(loan_amount - avg(loan_amount) OVER ()) / stddev_samp(loan_amount) OVER ()', 'loan_amount_std')}
FROM apps
""")
def q_scaled_applications(spark, sf_dir):
    a = tb.applications(spark, sf_dir).select("application_id", "credit_score", "loan_amount")
    a = cl.scale(a, min_max=["credit_score"], standard=["loan_amount"])
    return round_doubles(a.select("application_id", "credit_score_scaled", "loan_amount_std"))


def _feature_matrix(spark, sf_dir):
    apps = tb.applications(spark, sf_dir)
    stubs = tb.income_documents(spark, sf_dir).filter(F.col("document_type") == "paystub")
    fields = docs_op.extract_document_fields(stubs)
    idp = fields.groupBy("application_id").agg(F.max("net_income").alias("verified_net_income"))
    txn = feat.transaction_features(feat.parse_transactions(tb.statements(spark, sf_dir)))
    m = cl.assemble_feature_matrix(apps, idp)
    m = feat.with_transaction_features(m, txn)
    return cl.interaction_features(m)


@register("feature_matrix", f"""
WITH {APPS_SQL},
idp AS (SELECT o_custkey AS application_id, max(round(o_totalprice * 0.8, 2)) AS verified_net_income
        FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
tf AS ({txn_feature_sql(lambda e, alias: f'{e} AS {alias}')}),
m AS (SELECT apps.*, idp.verified_net_income, coalesce(tf.risk_flag_count, 0) AS risk_flag_count,
        coalesce(tf.income_stability_variance, 0) AS income_stability_variance,
        coalesce(tf.months_with_zero_overdraft, 0) AS months_with_zero_overdraft,
        coalesce(tf.monthly_emi_total, 0) AS monthly_emi_total,
        coalesce(tf.avg_salary_deposit, 0) AS avg_salary_deposit,
        tf.application_id IS NOT NULL AS has_transactions
      FROM apps LEFT JOIN idp ON apps.application_id = idp.application_id
      LEFT JOIN tf ON apps.application_id = tf.application_id)
SELECT application_id, {r('verified_net_income', 'verified_net_income')}, risk_flag_count, has_transactions,
  {r('loan_amount / (verified_net_income * 12 + 1)', 'loan_to_income_ratio')},
  {r('(loan_amount / loan_term) / (verified_net_income + 1)', 'payment_to_income_ratio')},
  {r('credit_score / (risk_flag_count + 1)', 'risk_score_composite')},
  {r('months_with_zero_overdraft / (income_stability_variance + 1)', 'financial_stability_score')},
  {r('(income_stability_variance + 1) * (monthly_emi_total / (avg_salary_deposit + 1))', 'stability_debt_ratio')},
  {r('CASE WHEN annual_income > 0 THEN (loan_amount / loan_term) / (annual_income / 12) END', 'debt_to_income_ratio')}
FROM m
""")
def q_feature_matrix(spark, sf_dir):
    m = _feature_matrix(spark, sf_dir)
    return round_doubles(m.select("application_id", "verified_net_income", "risk_flag_count", "has_transactions",
                                  "loan_to_income_ratio", "payment_to_income_ratio", "risk_score_composite",
                                  "financial_stability_score", "stability_debt_ratio", "debt_to_income_ratio"))


@register("class_balance", f"""
WITH {SCORED_SQL}
SELECT count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 1) AS positives,
  count(DISTINCT label) AS classes,
  {r('CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE label = 1), 0)', 'imbalance_ratio')},
  count(DISTINCT label) = 2 AS is_binary
FROM s
""")
def q_class_balance(spark, sf_dir):
    return round_doubles(cl.class_balance(tb.scored_population(spark, sf_dir)))


@register("stratified_split", f"""
WITH {SCORED_SQL},
h AS (SELECT *, CASE WHEN CAST(('0x' || substr(md5(CAST(application_id AS VARCHAR) || ':' || CAST(label AS VARCHAR)
                     || ':42'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM s)
SELECT split, label, count(*) AS n FROM h GROUP BY split, label
""")
def q_stratified_split(spark, sf_dir):
    s = cl.stratified_hash_split(tb.scored_population(spark, sf_dir), "application_id")
    return s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Explanations of a linear score (G1b, G2-G6) -- exact, so SQL can check them
# ---------------------------------------------------------------------------
from lendlens.operators import explain as xp  # noqa: E402
from lendlens.functions import rules as RL  # noqa: E402

# fixture weights (ours) of a linear default score over application columns
EXPLAIN_WEIGHTS = {"credit_score": -0.01, "age": -0.02, "loan_amount": 0.00005, "loan_term": 0.01,
                   "annual_income": -0.00002, "avg_monthly_balance": -0.0001}
EXPLAIN_INTERCEPT = 6.0


def explain_inputs(spark, sf_dir):
    apps = tb.applications(spark, sf_dir).select("application_id", *EXPLAIN_WEIGHTS)
    scored = met.decisions(xp.linear_score(apps, EXPLAIN_WEIGHTS, EXPLAIN_INTERCEPT))
    return xp.linear_contribution_rows(scored, EXPLAIN_WEIGHTS, EXPLAIN_INTERCEPT, background=apps)


def _explain_long(spark, sf_dir):
    apps = tb.applications(spark, sf_dir).select("application_id", *EXPLAIN_WEIGHTS)
    return xp.linear_contributions(apps, EXPLAIN_WEIGHTS, EXPLAIN_INTERCEPT)[0]


def phi_sql() -> str:
    means = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in EXPLAIN_WEIGHTS)
    rows = " UNION ALL ".join(
        f"SELECT application_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, "
        f"{w} * (CAST({f} AS DOUBLE) - m_{f}) AS phi FROM apps, mm" for f, w in EXPLAIN_WEIGHTS.items())
    z = " + ".join(f"{w} * CAST({f} AS DOUBLE)" for f, w in EXPLAIN_WEIGHTS.items())
    return f"""{APPS_SQL},
mm AS (SELECT {means} FROM apps),
phi AS ({rows}),
dec AS (SELECT application_id, 1.0 / (1.0 + exp(-({EXPLAIN_INTERCEPT} + {z}))) AS probability FROM apps),
dec2 AS (SELECT *, CASE WHEN probability < 0.5 THEN 'approved' ELSE 'denied' END AS decision FROM dec)"""


@register("linear_contributions", f"""
WITH {phi_sql()}
SELECT application_id, feature, {r('value', 'value')}, {r('phi', 'phi')} FROM phi
""")
def q_linear_contributions(spark, sf_dir):
    return round_doubles(_explain_long(spark, sf_dir))


_REASON_CASE = "CASE feature " + " ".join(
    "WHEN '{}' THEN '{}'".format(f, t.replace("'", "''")) for f, t in RL.REASON_CODES) + \
    " ELSE 'Feature ''' || feature || ''' does not meet requirements' END"


@register("adverse_action_reasons", f"""
WITH {phi_sql()},
ranked AS (SELECT p.application_id, p.feature, p.phi,
             row_number() OVER (PARTITION BY p.application_id ORDER BY abs(p.phi) DESC, p.feature) AS rk
           FROM phi p JOIN dec2 d ON p.application_id = d.application_id
           WHERE d.decision = 'denied' AND p.phi > 0)
SELECT application_id, string_agg({_REASON_CASE}, ' | ' ORDER BY rk) AS reasons
FROM ranked WHERE rk <= 3 GROUP BY application_id
""")
def q_adverse_action_reasons(spark, sf_dir):
    rows, _ = explain_inputs(spark, sf_dir)
    arr = xp.adverse_action_reasons(rows.filter(F.col("decision") == "denied"))
    return arr.filter(F.size("adverse_action_reasons") > 0).select(
        "application_id", F.concat_ws(" | ", "adverse_action_reasons").alias("reasons"))


@register("batch_explanations", f"""
WITH {phi_sql()},
lo AS (SELECT application_id, arg_min(feature, (phi, feature)) AS top_negative_feature, min(phi) AS top_negative_impact
       FROM phi GROUP BY application_id)
SELECT d.application_id, d.decision, {r('d.probability', 'probability')}, lo.top_negative_feature,
  {r('lo.top_negative_impact', 'top_negative_impact')}
FROM dec2 d JOIN lo ON d.application_id = lo.application_id
""")
def q_batch_explanations(spark, sf_dir):
    rows, _ = explain_inputs(spark, sf_dir)
    return round_doubles(xp.batch_explanations(rows))


@register("global_importance", f"""
WITH {phi_sql()}
SELECT feature, {r('avg(abs(phi))', 'mean_abs_phi')} FROM phi GROUP BY feature ORDER BY avg(abs(phi)) DESC LIMIT 20
""")
def q_global_importance(spark, sf_dir):
    return round_doubles(xp.global_importance(_explain_long(spark, sf_dir)))


@register("waterfall", f"""
WITH {phi_sql()},
b AS (SELECT round({EXPLAIN_INTERCEPT} + {' + '.join(f'{w} * m_{f}' for f, w in EXPLAIN_WEIGHTS.items())}, 8) AS base FROM mm)
SELECT application_id, feature, {r('phi', 'phi')},
  row_number() OVER (PARTITION BY application_id ORDER BY abs(phi) DESC, feature) AS step,
  {r('b.base + sum(phi) OVER (PARTITION BY application_id ORDER BY abs(phi) DESC, feature ROWS UNBOUNDED PRECEDING)', 'cumulative')}
FROM phi, b
""")
def q_waterfall(spark, sf_dir):
    rows, base = explain_inputs(spark, sf_dir)
    return round_doubles(xp.waterfall(rows, round(base, 8)))


@register("explanation_records")
def q_explanation_records(spark, sf_dir):
    rows, base = explain_inputs(spark, sf_dir)
    return xp.explanation_records(rows.drop(*EXPLAIN_WEIGHTS), base)


# ---------------------------------------------------------------------------
# Gradient-boosted model (F1, F2, F6, F10, F11) -- no SQL twin (iterative fit)
# ---------------------------------------------------------------------------
from lendlens.operators import model as mdl  # noqa: E402

MODEL_NUMERIC = ["n_chars", "toxic"]
MODEL_CATEGORICAL = ["lang", "source"]


_FITTED: dict[tuple[str, str], tuple] = {}


def fit_document_model(spark, sf_dir):
    """The model and its split population, fitted once per session and table folder: several queries
    ask for it. The training rows are written before the fit, which reads them for every level of every tree."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _FITTED:
        ensure_checkpoint_dir(spark)
        s = met.hash_split(tb.scored_population(spark, sf_dir).drop("probability"), "application_id")
        train = mdl.class_weight_column(s.filter(F.col("split") == "train")).checkpoint()
        pipe = mdl.gbt_pipeline(MODEL_NUMERIC, MODEL_CATEGORICAL, weight_col="weight")
        _FITTED[at] = (pipe.fit(train), s)
    return _FITTED[at]


@register("gbt_test_scores")
def q_gbt_test_scores(spark, sf_dir):
    model, s = fit_document_model(spark, sf_dir)
    test = s.filter(F.col("split") == "test")
    return mdl.batch_score(model, test, MODEL_NUMERIC + MODEL_CATEGORICAL)


@register("gbt_feature_importances")
def q_gbt_feature_importances(spark, sf_dir):
    model, s = fit_document_model(spark, sf_dir)
    return mdl.top_features(mdl.feature_importances(model, s), 10)


# ---------------------------------------------------------------------------
# Streaming twins (I1-I4), run with trigger(availableNow=True)
# ---------------------------------------------------------------------------
from lendlens.streaming import jobs as sj  # noqa: E402


@register("stream_scored_log", f"""
WITH {LOG_SQL}
SELECT id, application_id, decision, confidence_label FROM lg
""")
def q_stream_scoredlog_rows(spark, sf_dir):
    path = sj.scratch_path(spark, "ingest")
    sj.run_to_parquet(sj.ingest(sj.log_stream(spark, sf_dir)), path)
    return sj.read_final(spark, path).select("id", "application_id", "decision", "confidence_label")


@register("stream_daily_stats", f"""
WITH {LOG_SQL}
SELECT date_trunc('day', "timestamp") AS window_start, date_trunc('day', "timestamp") + INTERVAL 1 DAY AS window_end,
  count(*) AS predictions, {r("avg(CASE WHEN decision = 'approved' THEN 1.0 ELSE 0.0 END)", 'approval_rate')},
  {r('avg(loan_amount)', 'avg_loan_amount')}
FROM lg GROUP BY 1, 2
""")
def q_stream_daily_stats(spark, sf_dir):
    path = sj.scratch_path(spark, "daily")
    sj.run_to_parquet(sj.windowed_stats(sj.log_stream(spark, sf_dir)), path, keys=["window_start"], mode="update")
    return round_doubles(sj.read_final(spark, path, keys=["window_start"]))


@register("stream_group_gaps", f"""
WITH {LOG_SQL},
g AS (SELECT date_trunc('day', "timestamp") AS window_start, gender AS "group", count(*) AS n,
        count(*) FILTER (WHERE decision = 'approved') AS approved FROM lg GROUP BY 1, 2),
o AS (SELECT *, CAST(approved AS DOUBLE) / n AS rate,
        CAST(sum(approved) OVER (PARTITION BY window_start) AS DOUBLE) / sum(n) OVER (PARTITION BY window_start)
          AS overall_rate FROM g)
SELECT window_start, "group", n, approved, {r('rate', 'rate')}, {r('overall_rate', 'overall_rate')},
  {r('max(abs(rate - overall_rate)) OVER (PARTITION BY window_start)', 'max_gap_to_overall')}
FROM o
""")
def q_stream_group_gaps(spark, sf_dir):
    path = sj.scratch_path(spark, "groups")
    keys = ["window_start", "group"]
    sj.run_to_parquet(sj.windowed_group_rates(sj.log_stream(spark, sf_dir)), path, keys=keys, mode="update")
    return round_doubles(sj.analyze_group_gaps(sj.read_final(spark, path, keys=keys)).drop("dp_difference"))


def _summary_cte(name: str, threshold: float) -> str:
    """CTEs ``{name}`` = (sensitive_feature, dp, eo) for predictions at ``threshold``."""
    return f"""{name}_s AS (SELECT * REPLACE (CASE WHEN probability >= {threshold} THEN 1 ELSE 0 END AS prediction)
  FROM s),
{name}_g AS ({_group_metric_sql('lang', name + '_s')} UNION ALL {_group_metric_sql('source', name + '_s')}),
{name}_m AS (SELECT sensitive_feature, grp, {_div('tp + fp', 'n')} AS sr, {_div('fp', 'fp + tn')} AS fpr,
  {_div('tp', 'tp + fn')} AS tpr FROM {name}_g),
{name} AS (SELECT sensitive_feature, max(sr) - min(sr) AS dp,
  greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo FROM {name}_m WHERE grp <> 'Overall'
  GROUP BY sensitive_feature)"""


@register("fairness_before_after", f"""
WITH {SCORED_SQL}, {_summary_cte('base', 0.5)}, {_summary_cte('mit', 0.6)}
SELECT b.sensitive_feature, 'Demographic Parity Difference' AS metric, {r('b.dp', 'baseline')},
  {r('m.dp', 'mitigated')}, {r('b.dp - m.dp', 'improvement')}
FROM base b JOIN mit m ON b.sensitive_feature = m.sensitive_feature
UNION ALL
SELECT b.sensitive_feature, 'Equalized Odds Difference', {r('b.eo', 'baseline')},
  {r('m.eo', 'mitigated')}, {r('b.eo - m.eo', 'improvement')}
FROM base b JOIN mit m ON b.sensitive_feature = m.sensitive_feature
""")
def q_fairness_before_after(spark, sf_dir):
    """H6: baseline (threshold 0.5) against a stricter operating point (0.6)."""
    s = tb.scored_population(spark, sf_dir)
    base = s.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    mit = s.withColumn("prediction", (F.col("probability") >= 0.6).cast("int"))
    sb = fair.fairness_summary(fair.metrics_by_group(base, ["lang", "source"]))
    sm = fair.fairness_summary(fair.metrics_by_group(mit, ["lang", "source"]))
    return round_doubles(fair.before_after_report(sb, sm))


from lendlens.plans import catalog_models, catalog_more  # noqa: E402, F401  (register further queries)
