"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one failure bit per rule; policies (a name, a version, the rules that
reject) are applied to the ledger afterwards, and the effect of leaving a rule
out comes from aggregating the bits, without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = regex.compile(r"[#*$%&|<>]")
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

# rule -> SQL over the measurements that is true where a document fails; the
# order gives the bit, so rules are only ever appended
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "10 * word_chars < 15 * n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 7 * n_lines",
}


def failure_bits(rules) -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(rules)]
    return sum(bits[1:], bits[0]).cast("long")


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails more than ``allowed`` of the policy's rules."""

    name: str
    version: int
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)

    def rejects(self, bits: Column) -> Column:
        return F.bit_count(bits.bitwiseAND(F.lit(self.mask).cast("long"))) > self.allowed


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(RULES))
LENIENT = Policy("lenient", 1, tuple(RULES), allowed=1)


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES; null has none of anything."""
    if not text:
        return (0,) * len(MEASURES)
    lines, seen, dup, n_lines, words = text.split("\n"), set(), 0, 0, []
    for line in lines:
        found = WORD.findall(line)
        if found:
            n_lines += 1
            dup += line in seen
            seen.add(line)
            words += found
    n = len(words)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeat = 0
    if n > 3:
        # windows get numbers in two steps, so that the products stay exact in 64 bits
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, window, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[window] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[again + k] = True
        repeat = int(covered.sum())
    return n, sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeat, n_lines


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed): one row per document, with one bit per failed rule.

    Null and blank texts measure zero everywhere. Every row is judged by
    itself, so repeated rows and null ids need no care; an empty table gives
    an empty ledger; other columns are not read.
    """
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))],
                                             names=["id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(rate, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return rows.withColumn("failed", failure_bits(RULES.values()))


def apply_policy(book: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    return book.withColumn(out, ~policy.rejects(F.col("failed")))


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """(policy, version, rule, n_failed, n_only, n_kept_without): per rule of the policy.

    The ledger is first summed by its failure bits; all counts come from that
    table, which has a row per combination of failures that occurs.
    """
    by_bits = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")) \
        .agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(Policy("", 0, (r,)).mask).cast("long").alias("bit"))
                                for r in policy.rules])).alias("x")
    each = by_bits.select("bits", "n", rules).select("bits", "n", "x.rule", "x.bit")
    rejected = F.bit_count("bits") > policy.allowed
    rejected_without = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("bit"))) > policy.allowed
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(rejected & ~rejected_without, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(~rejected_without, F.col("n")).otherwise(0)).alias("n_kept_without"),
    ).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "rule", "n_failed", "n_only", "n_kept_without")


def measured(text: pd.Series) -> pd.DataFrame:
    """The measurements of a batch of texts."""
    return pd.DataFrame([measure(t) for t in text], columns=list(MEASURES), dtype="int64")


def keep_good(docs: DataFrame, text_col: str = "text", policy: Policy = STANDARD) -> DataFrame:
    """The rows of ``docs`` that the policy keeps. Each row is judged by itself, in place, without a shuffle.

    A null text counts as empty, so the standard policy rejects it like a blank one; repeated rows
    are judged alike; an empty table gives an empty one; columns of any names keep their values."""
    inside = F.pandas_udf(measured, ", ".join(f"{m} long" for m in MEASURES))
    judged = docs.select(F.struct(*docs.columns).alias("row"), inside(F.coalesce(text_col, F.lit(""))).alias("measured"))
    kept = judged.select("row", "measured.*").filter(~policy.rejects(failure_bits(RULES.values())))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
