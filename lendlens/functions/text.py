"""Column expressions for statement and document text.

Every function here takes and returns ``Column`` objects built from
``pyspark.sql.functions`` only, so they compile into whole-stage codegen
and never start a Python worker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendlens.functions import rules

# ASCII whitespace, spelled out so Java and RE2 agree on it.
WS = r"[ \t\n\x0B\f\r]"

# Money is DECIMAL(18,2): sums are exact, so results do not depend on the
# order in which partitions are combined (retries and AQE cannot change them).
MONEY = "decimal(18,2)"

# A money token in a statement line: optional sign before or after "$",
# thousands separators, optional cents, optional parentheses for debits.
MONEY_TOKEN = r"\(?-?\$-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)?|\(?-?(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}\)?"

# A transaction: DATE  DESCRIPTION  AMOUNT, anywhere in a line. The amount is the
# first money token after the description (a bare whole number only at the end
# of the line); what follows it, like a balance column, is left alone.
TXN = (r"(?<![\d/])(" + rules.DATE_TOKEN + r")(?![\d/])" + WS + r"+((?:(?!" + rules.DATE_TOKEN + r").)+?)" + WS
       + r"+((?:" + MONEY_TOKEN + r")(?=" + WS + r"|$)|\(?-?(?:\d{1,3}(?:,\d{3})+|\d+)\)?(?=" + WS + r"*$))")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def categorize(c, rule_list=None, *, default="other", empty="unknown") -> Column:
    """Ordered, first-match categoriser (word-bounded statement rules by default)."""
    c = _col(c)
    rule_list = rule_list or rules.LINE_CATEGORY_RULES
    low = F.lower(c)
    expr = F.when(c.isNull() | (c == ""), F.lit(empty))
    for name, pattern in rule_list:
        expr = expr.when(low.rlike(pattern), F.lit(name))
    return expr.otherwise(F.lit(default))


def categorize_transaction(c) -> Column:
    """Five-class description categoriser; each class is one alternation."""
    flat = [(name, "(" + "|".join(pats) + ")") for name, pats in rules.TRANSACTION_CATEGORY_RULES]
    return categorize(c, flat, default="Other", empty="Other")


def _strip_money(tok: Column) -> Column:
    return F.regexp_replace(tok, r"[\$,()\-]", "")


def extract_amount(c, mode: str = "first_money") -> Column:
    """Unsigned DECIMAL amount of a statement line; 0 when no amount is found.

    ``first_money``: first token carrying ``$`` or cents -- dates are skipped, and
    a balance column after the amount does not count; ``last_money``: the last one.
    ``first_token``: first number-like token, the older behaviour.
    """
    c = _col(c)
    if mode == "first_token":
        tok = F.regexp_extract(c, rules.FIRST_TOKEN, 0)
    elif mode in ("first_money", "last_money"):
        tok = F.try_element_at(F.regexp_extract_all(c, F.lit(MONEY_TOKEN), 0), F.lit(1 if mode == "first_money" else -1))
    else:
        raise ValueError(f"unknown amount mode: {mode}")
    val = _strip_money(tok).try_cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    return F.when(c.isNull(), zero).otherwise(F.coalesce(val, zero))


def signed_amount(tok) -> Column:
    """Amount text to a signed DECIMAL: '-' before or after '$', or parentheses, mean debit."""
    tok = _col(tok)
    mag = _strip_money(tok).try_cast(MONEY)
    neg = tok.contains("-") | tok.startswith("(")
    return F.when(neg, -mag).otherwise(mag)


def is_debit(c) -> Column:
    c = _col(c)
    pat = "(" + "|".join(rules.DEBIT_KEYWORDS) + ")"
    return F.coalesce(F.lower(c).rlike(pat).cast("int"), F.lit(0))


def contains_any(c, words) -> Column:
    low = F.lower(_col(c))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def clean_text(c) -> Column:
    """Collapse whitespace, keep letters, digits, whitespace and ``$ . , - /``, trim."""
    c = _col(c)
    collapsed = F.regexp_replace(c, WS + "+", " ")
    kept = F.regexp_replace(collapsed, r"[^a-zA-Z0-9 \t\n\x0B\f\r$.,\-/]", "")
    return F.coalesce(F.trim(kept), F.lit(""))


def parse_currency(c) -> Column:
    """Drop ``$`` and ``,``; unparsable -> 0.0."""
    return F.coalesce(F.regexp_replace(_col(c).cast("string"), r"[\$,]", "").try_cast("double"),
                      F.lit(0.0))


def parse_date(c, formats=None) -> Column:
    """First format in ``rules.DATE_FORMATS`` that parses the value, else null."""
    c = _col(c)
    formats = formats or rules.DATE_FORMATS
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])


def currency_scalar(c) -> Column:
    """Keep digits and '.', then cast; null when nothing parses (sign is lost)."""
    return F.regexp_replace(_col(c), r"[^\d.]", "").try_cast("double")


def all_dates(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(rules.DATE_TOKEN), 0)


def parse_statement_date(c) -> Column:
    c = _col(c)
    return F.coalesce(F.to_date(F.try_to_timestamp(c, F.lit("M/d/yyyy"))),
                      F.to_date(F.try_to_timestamp(c, F.lit("M/d/yy"))))


def _last_match(c, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), group), F.lit(-1))


# Field patterns for pay stubs and statements: keyword, optional qualifier,
# optional ':' or '=', then the value. The last match in a text wins.
NET_PAY = r"(?i)\b(?:net|take-home)(?:[ \t]+(?:pay|income|salary))?[ \t]*[:=]?[ \t]*(" + rules.FIELD_NUMBER + ")"
GROSS_PAY = r"(?i)\bgross(?:[ \t]+(?:pay|income|salary))?[ \t]*[:=]?[ \t]*(" + rules.FIELD_NUMBER + ")"
PAY_PERIOD = r"(?i)\bpay[ \t]+period[ \t]*[:=]?[ \t]*(\d{1,2}/\d{1,2}/\d{2,4})(?:[ \t]*-[ \t]*(\d{1,2}/\d{1,2}/\d{2,4}))?"
BALANCE = r"(?i)\b(?:balance|ending|current)(?:[ \t]+(?:balance|amount))?[ \t]*[:=]?[ \t]*(" + rules.FIELD_NUMBER + ")"


def document_fields(text, document_type) -> dict[str, Column]:
    """Pay-stub / statement fields as named columns (last match wins)."""
    text, document_type = _col(text), _col(document_type)
    low = F.lower(text)
    bank = F.lit(None).cast("string")
    for name in reversed(rules.BANK_NAMES):
        bank = F.when(low.contains(name.lower()), F.lit(name)).otherwise(bank)
    period_start = _last_match(text, PAY_PERIOD, 1)
    period_end = _last_match(text, PAY_PERIOD, 2)
    return {
        "net_income": currency_scalar(_last_match(text, NET_PAY)),
        "gross_income": currency_scalar(_last_match(text, GROSS_PAY)),
        "pay_period_start": period_start,
        "pay_period_end": F.when(period_end != "", period_end),
        "account_balance": currency_scalar(_last_match(text, BALANCE)),
        "bank_name": F.when(document_type == "bank_statement", bank),
    }
