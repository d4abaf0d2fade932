"""URL verdicts from a rule list and from mined association rules.

Where no listed rule fits, token combinations decide: FP-growth runs over the
tokens of labelled URLs plus one label item; rules that lead to a label and
keep enough support, confidence and lift form an inverted index, filed under
their rarest token. A URL probes the index with its own tokens and takes the
most confident rule whose tokens it holds.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label="
PARTS = r"://([^/?#]*)([^?#]*)"


def host(url: str | Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens(url: str = "url") -> Column:
    """Distinct tokens: scheme, host, host labels, path words, names in the query; digits become 0."""
    u = F.coalesce(F.col(url), F.lit(""))
    zeroed = F.regexp_replace(F.translate(u, UPPER, LOWER), "[0-9]+", "0")

    def tagged(tag: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(tag), w))

    return F.array_distinct(F.concat(
        tagged("s:", F.array(F.regexp_extract(zeroed, "^([^:/?#]+)://", 1))),
        tagged("d:", F.array(host(u))),
        tagged("h:", F.split(F.regexp_extract(zeroed, PARTS, 1), r"[.:@]")),
        tagged("p:", F.split(F.regexp_extract(zeroed, PARTS, 2), r"[/._~-]")),
        tagged("q:", F.regexp_extract_all(F.regexp_extract(zeroed, r"\?([^#]*)", 1), F.lit(r"([^&=]+)=?[^&]*"), 1))))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_lift: float = 1.2, min_count: int = 20) -> DataFrame:
    """(tokens, anchor, verdict, confidence, support) from (tokens, verdict) rows.

    A rule holds in ``min_support`` of the rows and in ``min_count`` of them at
    least. ``anchor`` is the rule's rarest token, ties to the smallest. Rows without
    a verdict are ignored; with no labelled rows there are no rules.
    """
    rows = labelled.filter("verdict IS NOT NULL") \
        .select(F.array_distinct(F.concat(F.col("tokens"), F.array(F.concat(F.lit(LABEL), F.col("verdict"))))).alias("items"))
    rows = staged(rows, "labelled")
    empty = "tokens array<string>, anchor string, verdict string, confidence double, support double"
    n = rows.count()
    if n < min_count or not n:
        return rows.sparkSession.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(rows)
    frequent = model.freqItemsets.filter("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    head = F.col("consequent")[0]
    rules = model.associationRules.filter(head.startswith(LABEL) & (F.col("lift") >= min_lift)) \
        .filter(~F.exists("antecedent", lambda t: t.startswith(LABEL))) \
        .select(F.array_sort("antecedent").alias("tokens"), F.substring(head, len(LABEL) + 1, 1 << 20).alias("verdict"), "confidence", "support")
    rules = staged(rules, "rules")
    rare = rules.select("tokens", F.explode("tokens").alias("token")).join(frequent, "token") \
        .groupBy("tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    return rules.join(rare, "tokens").select("tokens", "anchor", "verdict", "confidence", "support")


def match_mined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined): the verdict of the most confident rule that each URL holds; ties go to
    more support, more tokens, then the smaller tokens and verdict. URLs that hold no rule are left out."""
    probe = urls.select("url", "tokens", F.explode("tokens").alias("anchor"))
    index = rules.select(F.col("tokens").alias("needs"), "anchor", "verdict", "confidence", "support")
    hits = probe.join(index, "anchor").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.min(F.struct(-F.col("confidence"), -F.col("support"), -F.size("needs"), "needs", "verdict"))
    return hits.groupBy("url").agg(best["verdict"].alias("mined"))


def match_listed(urls: DataFrame, listed: list[tuple[str, str, str]]) -> DataFrame:
    """(url, rule, listed): the longest listed (verdict, host, path) that fits each URL.

    A rule fits its host and all subdomains where the path starts with the
    rule's. Of equally long ones the longer host wins, then block. URLs that no
    rule fits are left out. A URL probes only as many host suffixes as the longest rule has labels.
    """
    spark = urls.sparkSession
    rules = spark.createDataFrame(listed, "verdict string, rule_host string, rule_path string")
    labels = max([h.count(".") + 1 for _, h, _ in listed], default=1)
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, labels + 1)]))
    hits = urls.select("url", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host") \
        .filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule), F.length("rule_host"), "verdict", rule.alias("rule")))
    return hits.groupBy("url").agg(best.alias("b")).select("url", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("listed"))


def judge(pages: DataFrame, labels: DataFrame, listed: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id",
          url_col: str = "url", label_id: str = "id", min_support: float = 0.002, min_confidence: float = 0.8, min_lift: float = 1.2) -> DataFrame:
    """(id, host, path, rule, verdict, mined) for every page.

    ``labels`` holds (label_id, verdict) of some pages; a page with several
    labels counts once for each different one. A null URL, or one without ://, has
    an empty host and path, fits no listed rule and is judged by its tokens, if
    any, else by ``default``. Every URL is judged once, however many pages have
    it; repeated pages stay separate rows. Empty tables give empty results and other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = staged(rows.select("url").filter("url IS NOT NULL").distinct()
                  .withColumns({"host": host("url"), "path": path("url"), "tokens": tokens("url")}), "urls")
    known = labels.select(F.col(label_id).alias("id"), "verdict").distinct()
    rules = mine(rows.join(known, "id").select(tokens("url").alias("tokens"), "verdict"), min_support, min_confidence, min_lift)
    named = urls.join(match_listed(urls, listed), "url", "left")
    found = named.join(match_mined(urls, rules), "url", "left") \
        .select("url", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(default)).alias("verdict"), "mined")
    return rows.join(found, "url", "left").select(
        "id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"), "mined")
