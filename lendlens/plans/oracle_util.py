"""Helpers shared by the query catalog and its SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.sources.tables import DESCRIPTIONS

DIGITS = 4

# Expected categories of each fixture description, worked out by hand from
# the rule lists (this is what the parsers must reproduce).
LINE_CATEGORY = {
    "OVERDRAFT FEE": "overdraft", "NSF FEE RETURNED ITEM": "overdraft", "LATE FEE PENALTY": "late_fee",
    "DIRECT DEPOSIT PAYROLL": "salary", "ACH DEPOSIT SALARY": "salary", "PAYDAY CASH ADVANCE": "payday_loan",
    "AUTO LOAN PAYMENT": "debt_emi", "MORTGAGE PMT": "debt_emi", "CREDIT CARD PAYMENT": "debt_emi",
    "PG&E UTILITY BILL": "utility", "COMCAST INTERNET": "utility", "RENT TO LANDLORD": "rent",
    "STARBUCKS #1234": "other", "RESTAURANT DINING": "discretionary", "CASINO LOTTERY": "gambling",
}
TXN_CATEGORY = {
    "OVERDRAFT FEE": "Risk_Flag", "NSF FEE RETURNED ITEM": "Risk_Flag", "LATE FEE PENALTY": "Risk_Flag",
    "DIRECT DEPOSIT PAYROLL": "Income", "ACH DEPOSIT SALARY": "Income", "PAYDAY CASH ADVANCE": "Risk_Flag",
    "AUTO LOAN PAYMENT": "Debt_EMI", "MORTGAGE PMT": "Debt_EMI", "CREDIT CARD PAYMENT": "Other",
    "PG&E UTILITY BILL": "Utility", "COMCAST INTERNET": "Utility", "RENT TO LANDLORD": "Other",
    "STARBUCKS #1234": "Discretionary", "RESTAURANT DINING": "Discretionary", "CASINO LOTTERY": "Other",
}
DEBIT_FLAG = {d: int(any(w in d.lower() for w in ("debit", "withdrawal", "payment", "purchase", "fee", "charge")))
              for _, _, d, _ in DESCRIPTIONS}


def sql_case(mapping_of_description: dict, alias: str) -> str:
    parts = [f"WHEN o_orderpriority = '{p}' AND o_orderstatus = '{s}' THEN '{mapping_of_description[d]}'"
             for p, s, d, _ in DESCRIPTIONS]
    return "CASE " + " ".join(parts) + f" END AS {alias}"


def sql_case_int(mapping_of_description: dict, alias: str) -> str:
    parts = [f"WHEN o_orderpriority = '{p}' AND o_orderstatus = '{s}' THEN {mapping_of_description[d]}"
             for p, s, d, _ in DESCRIPTIONS]
    return "CASE " + " ".join(parts) + f" END AS {alias}"


def sql_signed_amount(alias: str = "amount") -> str:
    credits = " OR ".join(f"(o_orderpriority = '{p}' AND o_orderstatus = '{s}')" for p, s, _, c in DESCRIPTIONS if c)
    return f"CASE WHEN {credits} THEN o_totalprice ELSE -o_totalprice END AS {alias}"


def sql_description(alias: str = "description") -> str:
    parts = [f"WHEN o_orderpriority = '{p}' AND o_orderstatus = '{s}' THEN '{d}'" for p, s, d, _ in DESCRIPTIONS]
    return "CASE " + " ".join(parts) + f" END AS {alias}"


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column so results hash the same as the SQL twin.

    Written as round(x * 10^d) / 10^d, the way DuckDB's round(x, d) works,
    so ties resolve identically in both engines."""
    scale = float(10 ** digits)
    return df.select([(F.round(F.col(c) * scale) / scale).alias(c) if t in ("double", "float") else F.col(c)
                      for c, t in df.dtypes])


def r(expr: str, alias: str, digits: int = DIGITS) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {alias}"

