"""Further registered queries: statement layouts, cleaning, outliers, paging,
alerts, explanation records, oversampling, composed jobs and model invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lendlens.functions import rules
from lendlens.operators import clean as cl
from lendlens.operators import documents as docs_op
from lendlens.operators import explain as xp
from lendlens.operators import fairness as fair
from lendlens.operators import features as feat
from lendlens.operators import log as plog
from lendlens.operators import model as mdl
from lendlens.plans import jobs
from lendlens.plans.catalog import (AS_OF, EXPLAIN_INTERCEPT, EXPLAIN_WEIGHTS, LOG_SQL, MODEL_CATEGORICAL, MODEL_NUMERIC,
                                    SCORED_SQL, explain_inputs, fit_document_model, log_rows, phi_sql, recommendation_sql, register)
from lendlens.plans.oracle_util import LINE_CATEGORY, r, round_doubles, sql_case, sql_description, sql_signed_amount
from lendlens.sources import tables as tb


# ---------------------------------------------------------------------------
# Text (C2, C10)
# ---------------------------------------------------------------------------
@register("income_document_dates", """
SELECT o_orderkey AS document_id, CAST(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS BIGINT) AS n_dates,
  strftime(o_orderdate, '%m/%d/%Y') || CASE WHEN o_orderstatus = 'F' THEN ',' || strftime(o_orderdate + INTERVAL 14 DAY, '%m/%d/%Y') ELSE '' END AS dates
FROM orders
""")
def q_income_document_dates(spark, sf_dir):
    """C10 over pay stubs, statements and letters, which all hold dates."""
    d = docs_op.document_dates(tb.income_documents(spark, sf_dir), "raw_text")
    return d.select("document_id", F.size("dates").cast("long").alias("n_dates"), F.concat_ws(",", "dates").alias("dates"))


@register("statement_layouts", f"""
SELECT o_orderkey, CAST(0 AS BIGINT) AS match_no, CAST(o_orderdate AS DATE) AS txn_date, {sql_description()},
  {r('(' + sql_signed_amount('x')[:-5] + ')', 'amount')} FROM orders
UNION ALL
SELECT o_orderkey, 1, CAST(o_orderdate + INTERVAL 1 DAY AS DATE), 'NSF FEE', -35.0 FROM orders WHERE o_orderkey % 4 = 3
""")
def q_statement_layouts(spark, sf_dir):
    """C2 over four line layouts: plain; text before the date and a balance column;
    unpadded date and a suffix; two transactions on a line."""
    o = tb.table(spark, sf_dir, "orders")
    desc, amount = tb.description_text(), tb.amount_text()
    plain = F.concat_ws(" ", F.date_format("o_orderdate", "MM/dd/yyyy"), desc, amount)
    kind = F.pmod(F.col("o_orderkey"), F.lit(4))
    line = (F.when(kind == 0, plain)
            .when(kind == 1, F.concat_ws(" ", F.lit("Posted"), plain, F.lit("$12,345.67")))
            .when(kind == 2, F.concat_ws("   ", F.date_format("o_orderdate", "M/d/yyyy"), desc, amount, F.lit("CR")))
            .otherwise(F.concat_ws(" ", plain, F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "MM/dd/yyyy"), F.lit("NSF FEE ($35.00)"))))
    t = feat.parse_transactions(o.select("o_orderkey", line.alias("statement_text")), key="o_orderkey")
    return round_doubles(t.select("o_orderkey", F.col("match_no").cast("long").alias("match_no"), "txn_date", "description",
                                  F.col("amount").cast("double").alias("amount")))


@register("nlp_job_counts", f"""
WITH t AS (SELECT o_custkey AS application_id, {sql_case(LINE_CATEGORY, 'category')} FROM orders)
SELECT application_id, count(*) AS transaction_count, count(*) FILTER (WHERE category = 'salary') AS salary_deposit_count, true AS has_terms
FROM t GROUP BY application_id
""")
def q_nlp_job_counts(spark, sf_dir):
    """The composed job, parse -> features -> TF-IDF terms."""
    out = jobs.nlp_job(tb.statements(spark, sf_dir))
    return out.select("application_id", "transaction_count", "salary_deposit_count",
                      F.coalesce(F.size("tfidf_terms") > 0, F.lit(False)).alias("has_terms"))


# ---------------------------------------------------------------------------
# Cleaning (B2, B3, B5-B8, B21, B25, D15, F3)
# ---------------------------------------------------------------------------
EVENT_SQL = """
WITH e AS (SELECT event_id, event_type, value FROM events UNION ALL
           SELECT -event_id, NULL, CASE WHEN event_id % 10 = 0 THEN value * 100 ELSE value END FROM events WHERE event_id % 3 = 0)"""


def _events_with_extremes(spark, sf_dir):
    """Events, and again every third one without its type, some of them a hundredfold."""
    e = tb.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    more = e.filter(F.col("event_id") % 3 == 0).select(
        (-F.col("event_id")).alias("event_id"), F.lit(None).cast("string").alias("event_type"),
        F.when(F.col("event_id") % 10 == 0, F.col("value") * 100).otherwise(F.col("value")).alias("value"))
    return e.unionByName(more)


@register("event_outliers", EVENT_SQL + """,
b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e GROUP BY event_type)
SELECT e.event_id, e.event_type, e.value FROM e JOIN b ON e.event_type IS NOT DISTINCT FROM b.event_type
WHERE e.value >= q1 - 1.5 * (q3 - q1) AND e.value <= q3 + 1.5 * (q3 - q1)
""")
def q_event_outliers(spark, sf_dir):
    """B8 where rows are removed and one group is null."""
    return cl.filter_outliers(_events_with_extremes(spark, sf_dir), "value", by=["event_type"], exact=True)


@register("event_outliers_zscore", EVENT_SQL + """,
b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM e)
SELECT e.event_id, e.event_type, e.value FROM e, b WHERE abs(value - m) <= 3 * s
""")
def q_event_outliers_zscore(spark, sf_dir):
    """B8b."""
    return cl.filter_outliers(_events_with_extremes(spark, sf_dir), "value", method="zscore")


@register("column_preparation", """
SELECT c_custkey AS customer_key, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END, CAST(-1.0 AS DOUBLE)) AS acct_balance,
  coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END, 'Unknown') AS market_segment, 0 AS late_fees
FROM customer
""")
def q_column_preparation(spark, sf_dir):
    """Clean names, cast text that is partly no number, fill constants, align, select."""
    c = tb.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" customer-key"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("acct balance"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("market.segment "), F.col("c_name").alias("c_name"))
    c = cl.cast_numeric(cl.clean_column_names(c), ["acct_balance", "no_such_column"])
    c = cl.fill_constants(c, {"market_segment": "Unknown"})
    return cl.align_to_columns(c, ["customer_key", "acct_balance", "market_segment", "late_fees"], {"acct_balance": -1.0})


@register("imputed_modes", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment,
                  CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS nation FROM customer),
ms AS (SELECT segment AS v FROM c WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1),
mn AS (SELECT nation AS v FROM c WHERE nation IS NOT NULL GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 1)
SELECT c_custkey, coalesce(segment, (SELECT v FROM ms)) AS segment, coalesce(nation, (SELECT v FROM mn)) AS nation FROM c
""")
def q_imputed_modes(spark, sf_dir):
    """B6 by mode, B7."""
    c = tb.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("nation"))
    return cl.impute(c, numeric=["nation"], categorical=["segment"], strategy="mode")


@register("quantity_quantiles", """
SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS probability,
       unnest(quantile_cont(l_quantity, [0.05, 0.25, 0.5, 0.75, 0.95])) AS value FROM lineitem
""")
def q_quantity_quantiles(spark, sf_dir):
    """D15, exact: l_quantity has a bounded domain."""
    return cl.quantiles(tb.table(spark, sf_dir, "lineitem"), "l_quantity", [0.05, 0.25, 0.5, 0.75, 0.95], exact=True)


@register("oversampled_embeddings", """
WITH c AS (SELECT count(*) FILTER (WHERE label <> 0) AS n0, count(*) FILTER (WHERE label = 0) AS n1 FROM embeddings)
SELECT greatest(n0, n1) AS negatives, greatest(n0, n1) AS positives, abs(n0 - n1) AS synthetic, true AS inside_the_box FROM c
""")
def q_oversampled_embeddings(spark, sf_dir):
    """Classes equal after oversampling, and every synthetic row inside the minority's bounds."""
    e = tb.table(spark, sf_dir, "embeddings")
    dims = [f"x{i}" for i in range(8)]
    rows = e.select((F.col("label") == 0).cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(dims)])
    out = cl.oversample(rows, dims)
    n = {x["label"]: x["count"] for x in rows.groupBy("label").count().collect()}
    minority = min(n, key=lambda c: (n[c], c))
    box = rows.filter(F.col("label") == minority).agg(*[F.min(c).alias(f"lo_{c}") for c in dims], *[F.max(c).alias(f"hi_{c}") for c in dims]).first()
    inside = reduce(lambda a, b: a & b, [F.col(c).between(box[f"lo_{c}"] - 1e-9, box[f"hi_{c}"] + 1e-9) for c in dims])
    return out.agg(F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.col("label") == 1).alias("positives"),
                   F.count_if("synthetic").alias("synthetic"), F.min(~F.col("synthetic") | inside).alias("inside_the_box"))


@register("duplicate_customers", """
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS kept, CAST(sum(n) - count(*) AS BIGINT) AS dropped
FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)
""")
def q_duplicate_customers(spark, sf_dir):
    """How many rows dedupe_customers drops."""
    return cl.duplicate_counts(tb.table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@register("skipped_rows", """
SELECT count(*) AS rows, count(*) FILTER (WHERE c_acctbal < 0) AS skipped FROM customer
""")
def q_skipped_rows(spark, sf_dir):
    """Rows an assembler would skip, where a negative balance leaves employment_length null."""
    return cl.invalid_counts(tb.applications(spark, sf_dir), ["employment_length", "credit_score"])


# ---------------------------------------------------------------------------
# Log and fairness
# ---------------------------------------------------------------------------
@register("log_page_after", f"""
WITH {LOG_SQL}
SELECT id, application_id, "timestamp", decision FROM lg
WHERE "timestamp" < TIMESTAMP '{AS_OF}' OR ("timestamp" = TIMESTAMP '{AS_OF}' AND id < 100)
ORDER BY "timestamp" DESC, id DESC LIMIT 100
""")
def q_log_page_after(spark, sf_dir):
    """S1 in its keyset form: the page that follows the row (AS_OF, 100)."""
    return plog.log_page_after(log_rows(spark, sf_dir), (AS_OF, 100), limit=100).select("id", "application_id", "timestamp", "decision")


@register("fairness_alerts", recommendation_sql(0.0001))
def q_fairness_alerts(spark, sf_dir):
    """H8 at a tolerance that real gaps exceed, so the message branch is seen."""
    return fair.recommendations(fair.log_fairness_audit(log_rows(spark, sf_dir), AS_OF, days_back=7), alert=0.0001)


# ---------------------------------------------------------------------------
# Explanations and model
# ---------------------------------------------------------------------------
_QUOTED = [(f, t.replace("'", "''")) for f, t in rules.REASON_CODES]
_LONG_REASON = "CASE feature " + " ".join(
    f"WHEN '{f}' THEN '{t}' || ' (Value: ' || printf('%.2f', value) || ', Impact: ' || printf('%.4f', phi) || ')'" for f, t in _QUOTED) \
    + " ELSE 'Feature ''' || feature || ''' does not meet requirements (Value: ' || printf('%.2f', value) || ')' END"


@register("explanation_summary", f"""
WITH {phi_sql()},
b AS (SELECT {EXPLAIN_INTERCEPT} + {' + '.join(f'{w} * m_{f}' for f, w in EXPLAIN_WEIGHTS.items())} AS base FROM mm),
lists AS (SELECT application_id, list(feature ORDER BY phi, feature) AS rising FROM phi GROUP BY application_id),
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY p.application_id ORDER BY abs(p.phi) DESC, p.feature) AS rk FROM phi p WHERE p.phi > 0),
texts AS (SELECT application_id, list({_LONG_REASON} ORDER BY rk) FILTER (WHERE rk <= 3) AS reasons FROM ranked GROUP BY application_id)
SELECT d.application_id, d.decision, {r('d.probability', 'probability')}, {r('b.base', 'base_value')}, array_to_string(l.rising, ',') AS features,
  array_to_string(l.rising[-5:], ',') AS top_positive, array_to_string(l.rising[1:5], ',') AS top_negative,
  CASE WHEN d.decision = 'denied' THEN array_to_string(CASE WHEN len(coalesce(t.reasons, [])) < 3
    THEN list_concat(coalesce(t.reasons, []), ['{rules.GENERIC_REASON}']) ELSE t.reasons END, ' | ') END AS reasons
FROM dec2 d JOIN lists l ON d.application_id = l.application_id LEFT JOIN texts t ON d.application_id = t.application_id, b
""")
def q_explanation_summary(spark, sf_dir):
    """G3 and the long form of G2, as text columns."""
    rows, base = explain_inputs(spark, sf_dir)
    rec = xp.explanation_records(rows, base)
    return round_doubles(rec.select(
        "application_id", "decision", "probability", "base_value", F.array_join(F.col("contributions.feature"), ",").alias("features"),
        F.array_join(F.col("top_positive.feature"), ",").alias("top_positive"), F.array_join(F.col("top_negative.feature"), ",").alias("top_negative"),
        F.array_join("adverse_action_reasons", " | ").alias("reasons")))


@register("gbt_invariants", f"""
WITH {SCORED_SQL},
h AS (SELECT *, CASE WHEN CAST(('0x' || substr(md5(CAST(application_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT)
                     / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM s)
SELECT count(*) AS scored, count(*) AS with_probability, count(*) AS decided_by_it, 'lang,n_chars,source,toxic' AS features, true AS shares_sum_to_one
FROM h WHERE split = 'test'
""")
def q_gbt_invariants(spark, sf_dir):
    """what must hold for any fitted model -- every test row scored, its
    probability in [0, 1] and its decision by it, importances of the true columns summing to 1."""
    model, s = fit_document_model(spark, sf_dir)
    scored = mdl.batch_score(model, s.filter(F.col("split") == "test"), MODEL_NUMERIC + MODEL_CATEGORICAL)
    p = F.col("default_probability")
    checks = scored.agg(F.count(F.lit(1)).alias("scored"), F.count_if(p.between(0.0, 1.0)).alias("with_probability"),
                        F.count_if((p < 0.5) == (F.col("decision") == "approved")).alias("decided_by_it"))
    shares = mdl.feature_importances(model, s).agg(
        F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("shares_sum_to_one")).first()
    return checks.withColumns({"features": F.lit(shares["features"]), "shares_sum_to_one": F.lit(shares["shares_sum_to_one"])})
