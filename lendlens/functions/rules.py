"""Rule tables that decide categories, reasons and thresholds.

Rules are plain data (ordered lists of ``(name, pattern)``), so users can
swap them; the operators in :mod:`lendlens.functions.text` compile each
list into one chained ``CASE WHEN`` expression that runs inside
whole-stage codegen.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES -- these must equal the behaviour being reproduced, so they are
# stated verbatim, in their natural order. Do not edit to "tidy" them.
# ---------------------------------------------------------------------------

# Statement-line categories (word-bounded, case-insensitive, first match wins).
LINE_CATEGORY_RULES: list[tuple[str, str]] = [
    ("salary", r"\b(salary|payroll|wages|income|pay\s*stub|employer|direct\s*deposit)\b"),
    ("debt_emi", r"\b(emi|loan\s*payment|credit\s*card|mortgage|installment|repayment)\b"),
    ("utility", r"\b(electric|water|gas|internet|phone|mobile|utility|bill)\b"),
    ("rent", r"\b(rent|lease|housing|landlord)\b"),
    ("overdraft", r"\b(overdraft|nsf|insufficient\s*funds|returned\s*check)\b"),
    ("late_fee", r"\b(late\s*fee|penalty|overdue|delinquent)\b"),
    ("payday_loan", r"\b(payday|cash\s*advance|short\s*term\s*loan)\b"),
    ("gambling", r"\b(casino|lottery|betting|poker|gambling)\b"),
    ("discretionary", r"\b(shopping|entertainment|restaurant|vacation|luxury)\b"),
]

# Transaction-description categories (substring search, case-insensitive,
# classes tried in this order, first match wins, else "Other").
TRANSACTION_CATEGORY_RULES: list[tuple[str, list[str]]] = [
    ("Income", [
        r"payroll", r"salary", r"direct\s*dep", r"ach\s*deposit",
        r"govt\s*benefit", r"social\s*security", r"unemployment",
        r"dividend", r"interest\s*income", r"refund", r"reimbursement",
    ]),
    ("Debt_EMI", [
        r"loan\s*pmt", r"mortgage", r"auto\s*loan", r"car\s*payment",
        r"klarna", r"afterpay", r"affirm", r"credit\s*card\s*pmt",
        r"student\s*loan", r"personal\s*loan", r"lease\s*payment",
    ]),
    ("Utility", [
        r"pg&e", r"pacific\s*gas", r"electric", r"water\s*dept",
        r"gas\s*company", r"comcast", r"att\s*bill", r"verizon",
        r"internet", r"phone\s*bill", r"cable", r"utilities",
    ]),
    ("Discretionary", [
        r"starbucks", r"restaurant", r"coffee", r"dining",
        r"netflix", r"spotify", r"amazon", r"entertainment",
        r"shopping", r"retail", r"grocery", r"food", r"uber",
        r"lyft", r"travel", r"hotel", r"airline",
    ]),
    ("Risk_Flag", [
        r"overdraft", r"nsf", r"insufficient\s*funds", r"late\s*fee",
        r"penalty", r"returned\s*check", r"payday\s*loan",
        r"cash\s*advance", r"collection", r"garnishment",
    ]),
]

# Words that mark a statement line as a debit (substring, case-insensitive).
DEBIT_KEYWORDS: list[str] = ["debit", "withdrawal", "payment", "purchase", "fee", "charge"]

# Substrings that mark reliance on payday lending.
PAYDAY_PATTERNS: list[str] = ["payday", "cash advance", "fast cash"]

# Bank names looked for in bank statements, first listed match wins.
BANK_NAMES: list[str] = [
    "Chase", "Bank of America", "Wells Fargo", "Citibank",
    "US Bank", "TD Bank", "Capital One",
]

# Date formats tried in order by ``parse_date`` (Python strptime spelling):
#   '%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d', '%b %d, %Y', '%B %d, %Y'
# and the same list in Spark datetime-pattern spelling (one letter: one or two digits):
DATE_FORMATS: list[str] = [
    "yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy",
]

# Number and date tokens.
FIRST_TOKEN = r"\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
DATE_TOKEN = r"\d{1,2}/\d{1,2}/\d{2,4}"
FIELD_NUMBER = r"\$?\d+[,\d]*\.?\d*"

# Adverse-action reason text per feature.
REASON_CODES: list[tuple[str, str]] = [
    ("risk_flag_count", "Frequent instances of overdrafts, non-sufficient funds, or late fees"),
    ("income_stability_variance", "Irregular or unverifiable income deposits"),
    ("utilization_ratio_proxy", "High ratio of monthly expenses to verified income"),
    ("credit_score", "Credit score does not meet minimum requirements"),
    ("monthly_emi_total", "High level of existing debt obligations"),
    ("loan_to_verified_income", "Requested loan amount is too high relative to verified income"),
    ("relies_on_payday_loans", "Recent use of high-risk payday loan or cash advance services"),
    ("months_with_zero_overdraft", "Insufficient history of maintaining positive account balance"),
    ("min_balance", "Insufficient available funds or negative account balance"),
    ("days_between_paychecks_std", "Inconsistent employment or income timing"),
    ("num_debt_payments", "High number of existing debt obligations"),
    ("financial_health_score", "Overall financial health indicators do not meet requirements"),
    ("age", "Length of credit history does not meet minimum requirements"),
    ("loan_term", "Requested loan term exceeds acceptable limits"),
    ("loan_amount", "Requested loan amount exceeds lending limits"),
]
GENERIC_REASON = "Overall risk profile does not meet lending criteria"

# Fairness messages.
DISPARITY_TEXT = (" disparity detected: ", "% difference in approval rates. Consider bias mitigation techniques.")
NO_DISPARITY_TEXT = "No significant fairness issues detected in the specified metrics."

# Decision thresholds and fairness tolerance.
APPROVAL_THRESHOLD = 0.50
HIGH_RISK_THRESHOLD = 0.70
LOW_RISK_THRESHOLD = 0.30
FAIRNESS_THRESHOLD = 0.05
DISPARITY_ALERT = 0.10
TOP_N_REASONS = 3

# Validation limits.
REQUIRED_FIELDS: list[str] = ["credit_score", "loan_amount", "loan_term", "age"]
CREDIT_SCORE_RANGE = (300, 850)
AGE_RANGE = (18, 100)

# Validation messages.
VALIDATION_TEXT = {
    "missing": "Missing required feature: {}",
    "null": "Feature {} is None",
    "score": "Credit score {} out of valid range [300, 850]",
    "age": "Age {} out of valid range [18, 100]",
    "amount": "Loan amount must be positive, got {}",
    "term": "Loan term must be positive",
    "income": "Annual income must be non-negative",
    "employment": "Employment length must be non-negative",
}

# Reason text for features without a reason of their own.
UNMAPPED_REASON = ("Feature '", "' does not meet requirements")

# Gradient-boosted model defaults.
GBT_DEFAULTS = dict(maxDepth=6, maxIter=100, stepSize=0.1, subsamplingRate=0.8,
                    featureSubsetStrategy="sqrt", minInstancesPerNode=10, maxBins=32)
# ---------------------------------------------------------------------------

# The English stop words that StopWordsRemover uses by default.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())
