"""Chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation once per turn, each time longer. A rolling
hash of every turn prefix shows which conversations are prefixes of longer
ones; an anti-join removes them, and only maximal conversations are rendered.

The prefix hash is the running sum of two 64-bit hashes of (position, role,
text). Sums over blocks of turns are added up first, so a conversation of any
length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.common import staged

TURNS_A_PART = 256
START, END = "<|im_start|>", "<|im_end|>"
BIG = "decimal(38,0)"


def _turns(conversations: DataFrame, per_part: int) -> DataFrame:
    """Turns with their block and the two hashes of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    block = F.coalesce(F.floor(F.col("turn") / F.lit(per_part)), F.lit(-(1 << 56)))  # turns without a number come first
    return conversations.filter("conv_id IS NOT NULL") \
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), block.alias("block")) \
        .withColumns({"t1": F.xxhash64("role", "text"), "t2": F.xxhash64("text", F.lit(1), "role")})


def _running(table: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Per conversation, the sum of each column over earlier blocks (as its new name)."""
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns({new: F.coalesce(F.sum(old).over(before), F.lit(0)).cast(BIG if old[0] == "s" else "long") for old, new in cols.items()})


def prefixes(conversations: DataFrame, per_part: int = TURNS_A_PART) -> DataFrame:
    """(conv_id, block, k, n, p1, p2): the hash of the first k of n turns of each conversation."""
    turns = staged(_turns(conversations, per_part).select("conv_id", "block", "turn", "t1", "t2").distinct(), "turns")
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    sizes = _running(sizes, {"size": "before"}).withColumn("n", F.sum("size").over(Window.partitionBy("conv_id")))
    own = Window.partitionBy("conv_id", "block").orderBy("turn", "t1", "t2")
    placed = turns.withColumn("at", F.row_number().over(own)).join(sizes, ["conv_id", "block"]) \
        .withColumn("k", F.col("before") + F.col("at")) \
        .withColumns({"h1": F.xxhash64("k", "t1").cast(BIG), "h2": F.xxhash64("t2", "k").cast(BIG)})
    placed = staged(placed.select("conv_id", "block", "k", "n", "h1", "h2"), "positions")
    sums = _running(placed.groupBy("conv_id", "block").agg(F.sum("h1").cast(BIG).alias("s1"), F.sum("h2").cast(BIG).alias("s2")), {"s1": "b1", "s2": "b2"})
    so_far = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns({"r1": F.sum("h1").over(so_far).cast(BIG), "r2": F.sum("h2").over(so_far).cast(BIG)}) \
        .join(sums, ["conv_id", "block"]) \
        .select("conv_id", "block", "k", "n", (F.col("b1") + F.col("r1")).cast(BIG).alias("p1"), (F.col("b2") + F.col("r2")).cast(BIG).alias("p2"))


def maximal(conversations: DataFrame, per_part: int = TURNS_A_PART) -> DataFrame:
    """(conv_id, block) of the conversations that no other one continues; of equal ones the smallest id."""
    found = staged(prefixes(conversations, per_part), "prefixes")
    whole = found.filter("k = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    longer = found.filter("k < n").select(F.col("k").alias("n"), "p1", "p2").distinct()
    kept = whole.join(longer, ["n", "p1", "p2"], "left_anti").select("conv_id")
    return found.select("conv_id", "block").distinct().join(kept, "conv_id", "left_semi")


def format_chats(conversations: DataFrame, per_part: int = TURNS_A_PART) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations, rendered.

    Turns are ordered by number, those without one first, equal numbers by a
    hash of role and text; repeated rows count once; null roles and texts are
    empty. Turns without a conversation id belong to none and are left out. A
    part holds the turns of ``per_part`` consecutive numbers, so a conversation
    longer than that has several rows, to be read in order of ``part``. The
    template's markers inside a text are broken up by a blank. An empty table
    gives an empty result; other columns are not read.
    """
    turns = _turns(conversations, per_part).join(maximal(conversations, per_part), ["conv_id", "block"], "left_semi")
    clean = F.regexp_replace("text", r"<\|(im_start|im_end)\|>", "<| $1 |>")
    line = F.concat(F.lit(START), F.col("role"), F.lit("\n"), clean, F.lit(END + "\n"))
    rows = F.array_sort(F.collect_set(F.struct("turn", "t1", "t2", line.alias("line"))))
    return turns.groupBy("conv_id", "block").agg(rows.alias("rows")) \
        .select("conv_id", F.col("block").alias("part"), F.size("rows").cast("long").alias("n_turns"),
                F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("text"))
