"""Readers for the provided tables and the business inputs derived from them.

The derived inputs (statements, transactions, applications, a scored
population, a prediction log) are plain DataFrame plans over the provided
Parquet tables, so their size grows with the data and Catalyst prunes
columns / pushes filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.functions.rules import BANK_NAMES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# A statement page holds the orders of one customer and month whose keys fall
# in one block of this many order keys, so a page never exceeds this many lines
# however hot a customer is.
STATEMENT_PAGE_KEYS = 100_000


def _sql_round(col, digits):
    scale = float(10 ** digits)
    return F.round(col * scale) / scale


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Statement lines from orders. Fixture rule (ours): order priority and status
# pick the description; credits are written "$1,234.56", debits "-$1,234.56".
# ---------------------------------------------------------------------------
DESCRIPTIONS = [
    # priority, status, description, is_credit
    ("1-URGENT", "F", "OVERDRAFT FEE", False),
    ("1-URGENT", "O", "NSF FEE RETURNED ITEM", False),
    ("1-URGENT", "P", "LATE FEE PENALTY", False),
    ("2-HIGH", "F", "DIRECT DEPOSIT PAYROLL", True),
    ("2-HIGH", "O", "ACH DEPOSIT SALARY", True),
    ("2-HIGH", "P", "PAYDAY CASH ADVANCE", True),
    ("3-MEDIUM", "F", "AUTO LOAN PAYMENT", False),
    ("3-MEDIUM", "O", "MORTGAGE PMT", False),
    ("3-MEDIUM", "P", "CREDIT CARD PAYMENT", False),
    ("4-NOT SPECIFIED", "F", "PG&E UTILITY BILL", False),
    ("4-NOT SPECIFIED", "O", "COMCAST INTERNET", False),
    ("4-NOT SPECIFIED", "P", "RENT TO LANDLORD", False),
    ("5-LOW", "F", "STARBUCKS #1234", False),
    ("5-LOW", "O", "RESTAURANT DINING", False),
    ("5-LOW", "P", "CASINO LOTTERY", False),
]


def _description(priority, status):
    expr = None
    for p, s, d, _ in DESCRIPTIONS:
        cond = (priority == p) & (status == s)
        expr = F.when(cond, F.lit(d)) if expr is None else expr.when(cond, F.lit(d))
    return expr.otherwise(F.lit("MISC"))


def _is_credit(priority, status):
    credit = [(p, s) for p, s, _, c in DESCRIPTIONS if c]
    cond = None
    for p, s in credit:
        c = (priority == p) & (status == s)
        cond = c if cond is None else cond | c
    return cond


def description_text():
    return _description(F.col("o_orderpriority"), F.col("o_orderstatus"))


def amount_text():
    money = F.concat(F.lit("$"), F.format_number(F.col("o_totalprice"), 2))
    return F.when(_is_credit(F.col("o_orderpriority"), F.col("o_orderstatus")), money).otherwise(F.concat(F.lit("-"), money))


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("application_id"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("statement_month"),
        F.floor(F.col("o_orderkey") / STATEMENT_PAGE_KEYS).alias("page"),
        F.col("o_orderdate"),
        F.col("o_orderkey"),
        F.concat_ws(" ", F.date_format("o_orderdate", "MM/dd/yyyy"), description_text(), amount_text()).alias("line"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement page per (customer, month, key block): ``statement_text``
    holds its lines in date / key order, newline separated."""
    lines = statement_lines(spark, sf_dir)
    return (lines.groupBy("application_id", "statement_month", "page")
            .agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "line"))).alias("l"))
            .select("application_id", "statement_month", "page",
                    F.concat_ws("\n", F.transform("l", lambda s: s["line"])).alias("statement_text")))


# ---------------------------------------------------------------------------
# Pay stubs and bank statements as text (fixture rule, ours): fully-filled
# orders become pay stubs, open orders bank statements, pending orders letters.
# ---------------------------------------------------------------------------
def income_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    start = F.date_format("o_orderdate", "MM/dd/yyyy")
    end = F.date_format(F.date_add(F.to_date("o_orderdate"), 14), "MM/dd/yyyy")
    bank = F.element_at(F.array(*[F.lit(b) for b in BANK_NAMES]),
                        (F.pmod(F.col("o_custkey"), F.lit(len(BANK_NAMES))) + 1).cast("int"))
    paystub = F.concat_ws("\n",
                          F.lit("EARNINGS STATEMENT"),
                          F.concat(F.lit("Pay period: "), start, F.lit(" - "), end),
                          F.concat(F.lit("Gross Pay: $"), F.format_number(price, 2)),
                          F.concat(F.lit("Net Pay: $"), F.format_number(_sql_round(price * 0.8, 2), 2)))
    statement = F.concat_ws("\n",
                            F.concat(bank, F.lit(" monthly account statement")),
                            F.concat(F.lit("Statement date "), start),
                            F.concat(F.lit("Ending Balance: $"), F.format_number(price, 2)))
    letter = F.concat(F.lit("Reference letter dated "), start, F.lit(" for customer "),
                      F.col("o_custkey").cast("string"))
    st = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("document_id"),
        F.col("o_custkey").alias("application_id"),
        F.when(st == "F", "paystub").when(st == "O", "bank_statement").otherwise("letter").alias("document_type"),
        F.when(st == "F", paystub).when(st == "O", statement).otherwise(letter).alias("raw_text"),
    )


# ---------------------------------------------------------------------------
# Applications: customer LEFT JOIN order totals LEFT JOIN nation.
# ---------------------------------------------------------------------------
def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders")
    totals = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("num_orders"),
        F.sum("o_totalprice").alias("total_ordered"),
        F.max("o_totalprice").alias("max_order"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("num_urgent"),
        F.min("o_orderdate").alias("first_order"),
    )
    return (c.join(totals, "c_custkey", "left")
            .join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"),
                  "c_nationkey", "left")
            .select(
                F.col("c_custkey").alias("application_id"),
                F.col("c_name").alias("applicant_name"),
                F.col("n_name").alias("nation"),
                F.col("c_mktsegment").alias("segment"),
                F.col("c_acctbal").alias("avg_monthly_balance"),
                (F.lit(300) + F.pmod(F.col("c_custkey") * 7919, F.lit(600))).cast("int").alias("credit_score"),
                (F.lit(16) + F.pmod(F.col("c_custkey") * 31, F.lit(60))).cast("int").alias("age"),
                F.when(F.col("c_acctbal") >= 0, _sql_round(F.col("c_acctbal") / 1000, 2)).alias("employment_length"),
                _sql_round(F.coalesce(F.col("max_order"), F.lit(0.0)) / 10, 2).alias("loan_amount"),
                F.element_at(F.array(F.lit(36), F.lit(60), F.lit(84), F.lit(120)),
                             (F.pmod(F.col("c_custkey"), F.lit(4)) + 1).cast("int")).alias("loan_term"),
                _sql_round(F.coalesce(F.col("total_ordered"), F.lit(0.0)) / 20, 2).alias("annual_income"),
                F.col("num_orders"),
                F.col("num_urgent").alias("num_derogatory_marks"),
                F.col("first_order"),
            ))


# ---------------------------------------------------------------------------
# Scored population for metrics and fairness (fixture rule, ours):
# label = 1 - quality (1 = "default"), probability = n / (n + 2000) from the
# document length, sensitive attributes = language and source.
# ---------------------------------------------------------------------------
SCORE_HALF_POINT = 2000.0


def scored_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(doc, "doc_id").select(
        F.col("doc_id").alias("application_id"),
        (F.lit(1) - F.col("quality")).alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(SCORE_HALF_POINT))).alias("probability"),
        F.col("lang"), F.col("source"), F.col("toxic"), F.col("n_chars"),
    )


# ---------------------------------------------------------------------------
# Prediction log (fixture rule, ours): one logged decision per event; the
# event value sets the probability, the customer gives name and the
# attributes audited for fairness (segment as "gender", region as "race").
# ---------------------------------------------------------------------------
def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey"), F.col("r_name"))
    p = F.least(F.col("value") / 500.0, F.lit(1.0))
    return (e.join(c, e.user_id == c.c_custkey, "left")
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("event_id").alias("id"),
                F.concat(F.lit("APP"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("application_id"),
                F.col("ts").alias("timestamp"),
                F.col("event_type").alias("submitted_by"),
                F.col("c_name").alias("applicant_name"),
                (F.lit(21) + F.pmod(F.col("user_id"), F.lit(50))).cast("int").alias("applicant_age"),
                F.col("c_mktsegment").alias("gender"),
                F.col("r_name").alias("race"),
                (F.col("value") * 100).alias("loan_amount"),
                F.element_at(F.array(F.lit(36), F.lit(60), F.lit(84), F.lit(120)),
                             (F.pmod(F.col("event_id"), F.lit(4)) + 1).cast("int")).alias("loan_term"),
                p.alias("probability"),
                F.col("props"),
            ))
