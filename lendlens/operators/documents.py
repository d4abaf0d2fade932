"""Document text: field extraction, cleaning, dates, TF-IDF.

Every step is a column expression or an explode + aggregate over whole
texts; the TF-IDF vocabulary is the only thing that reaches the driver and it
is bounded by its ``vocab_size`` parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.functions import text as T
from lendlens.functions.rules import ENGLISH_STOP_WORDS
from lendlens.operators.rank import written
from lendlens.session import ensure_checkpoint_dir


def extract_document_fields(docs: DataFrame, text_col: str = "raw_text",
                            type_col: str = "document_type") -> DataFrame:
    """Pay-stub and statement fields plus the raw text and type."""
    return docs.withColumns(T.document_fields(text_col, type_col))


def document_dates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every ``d/d/dddd`` date in the text, in order."""
    return docs.withColumn("dates", T.all_dates(text_col))


def clean_documents(docs: DataFrame, text_col: str = "text", out: str = "clean_text") -> DataFrame:
    """B15 over a whole table."""
    return docs.withColumn(out, T.clean_text(text_col))


def default_stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop words (``StopWordsRemover``), as plain data."""
    return ENGLISH_STOP_WORDS


def tokens(text_col: str = "text", pattern: str = r"\W+") -> "F.Column":
    """Lower-case, split on non-word runs (empty tokens removed later)."""
    return F.split(F.lower(F.col(text_col)), pattern)


def unigrams(text_col: str = "text", stop_words=None) -> "F.Column":
    """The row's terms without stop words, as an array."""
    stop = list(stop_words if stop_words is not None else default_stop_words())
    # isin over many literals becomes a hash-set lookup (InSet), not a scan
    return F.filter(tokens(text_col), lambda w: (w != "") & ~w.isin(stop))


WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


def long_words(text_col: str = "text", stop_words=None) -> "F.Column":
    """Words of two or more word characters without stop words."""
    stop = list(stop_words if stop_words is not None else default_stop_words())
    return F.filter(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_TOKEN), 0), lambda w: ~w.isin(stop))


def unigrams_and_bigrams(text_col: str = "text", stop_words=None) -> "F.Column":
    """The long words, then adjacent pairs of them."""
    words = long_words(text_col, stop_words)
    none = F.array().cast("array<string>")

    def pairs(k):
        n = F.greatest(F.size(k) - 1, F.lit(0))
        return F.concat(k, F.transform(F.arrays_zip(F.slice(k, 1, n).alias("a"), F.slice(k, F.lit(2), n).alias("b")),
                                       lambda p: F.concat_ws(" ", p["a"], p["b"])))

    # the words are bound once, as the element of a one-element array
    return F.coalesce(F.flatten(F.transform(F.array(words), pairs)), none)


TRACKED = 1 << 14  # terms that a heavy-hitter summary follows
SUMMARIES = 256  # summaries that meet in the last step


def heavy_terms(docs: DataFrame, terms: "F.Column", size: int, tracked: int = TRACKED) -> dict[str, int] | None:
    """The exact counts of the ``size`` most frequent terms, ties by term, or None where a summary cannot tell.

    Every task follows a bounded number of terms (frequent-items sketches), so no other term leaves it. The sketches
    name candidates and bound the count of all other terms; a second pass counts the candidates alone. Where the
    last of the ``size`` does not exceed the bound, another term might belong there, and nothing is returned."""
    top, bound = heavy_candidates(docs, terms, size, tracked)
    if not bound:  # no terms at all
        return {}
    counts = docs.select(F.explode(F.filter(terms, lambda t: t.isin(top))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    best = sorted(((-r["n"], r["term"].encode()) for r in counts))[:size]
    if len(best) < size or -best[-1][0] <= bound:
        return None
    return {t.decode(): -n for n, t in best}


def heavy_candidates(docs: DataFrame, terms: "F.Column", size: int, tracked: int = TRACKED) -> tuple[list[str], float]:
    """(terms that may be among the ``size`` most frequent, a bound for the count of any other)."""
    wanted = min(tracked // 4, 4 * size)
    rows = docs.select(F.explode(terms).alias("term"))
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(SUMMARIES)).alias("part")) \
        .agg(F.expr(f"approx_top_k_accumulate(term, {tracked})").alias("sketch"), F.count(F.lit(1)).alias("n"))
    found = parts.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {wanted})").alias("top"), F.sum("n").alias("n")).first()
    if found is None or not found["n"]:
        return [], 0.0
    top = [(t["item"], t["count"]) for t in found["top"]]
    # a sketch of m entries errs by at most 3.5 n / m; those it returns not have no more than the last it returns
    return [t for t, _ in top], max(3.5 * found["n"] / tracked, top[-1][1] if len(top) == wanted else 0)


def frequent_ngrams(docs: DataFrame, key: str, text_col: str, size: int, stop_words=None, tracked: int = TRACKED,
                    most: int = 4096) -> tuple[DataFrame, "F.Column", list[str]] | None:
    """(rows, their terms, vocabulary): the ``size`` most frequent words and pairs, by words alone, or None where over ``most`` words tie.

    A pair is no more frequent than either of its words. So a pair among the ``size`` most frequent terms, whose
    counts are at least the ``size``-th word's, consists of words with such counts. The rows keep these
    candidates of every text in their places and nothing of its other words; they are written once and hold all
    that the vocabulary and the weights need. A summary of the words names them, as in heavy_terms, and where it cannot
    tell, the counts of all words do."""
    words = long_words(text_col, stop_words)
    names, bound = heavy_candidates(docs, words, size, tracked)
    found = _ngram_counts(docs, key, words, names, size, bound) if len(names) >= size or not bound else None
    if found is None:  # all words are counted, and no pair
        counts = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        top = counts.orderBy(F.desc("n"), "term").limit(most + 1).collect()
        least = top[size - 1]["n"] if len(top) >= size else 0
        if len(top) > most and top[-1]["n"] >= least:
            return None
        found = _ngram_counts(docs, key, words, [r["term"] for r in top if r["n"] >= least], size, 0)
    return found


def _ngram_counts(docs, key, words, names, size, bound):
    """The rows of the words ``names``, their terms and the ``size`` most frequent; None unless ``size`` words exceed a ``bound`` above 0."""
    rows = written(docs.select(key, F.transform(words, lambda w: F.when(w.isin(names) if names else F.lit(False), w)).alias("_w")), "ngrams")
    pair = F.arrays_zip(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))).alias("a"), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))).alias("b"))
    pairs = F.transform(F.filter(pair, lambda p: p["a"].isNotNull() & p["b"].isNotNull()), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    terms = F.coalesce(F.concat(F.filter("_w", lambda w: w.isNotNull()), pairs), F.array().cast("array<string>"))
    if bound:
        single = rows.select(F.explode("_w").alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
        if len(single) < size or sorted(r["n"] for r in single)[-size] <= bound:
            return None
    return rows, terms, counted_vocabulary(rows, terms, size)


def top_vocabulary(docs: DataFrame, terms: "F.Column", size: int) -> list[str]:
    """The ``size`` most frequent terms of the corpus, ties by term; only they reach the driver.

    Two passes with bounded summaries where those decide, and otherwise counts of all terms, summed per task
    before the shuffle; the result is the same."""
    found = heavy_terms(docs, terms, size)
    if found is not None:
        return list(found)
    return counted_vocabulary(docs, terms, size)


def counted_vocabulary(docs: DataFrame, terms: "F.Column", size: int) -> list[str]:
    """The same from the counts of all terms."""
    counts = docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    return [r["term"] for r in counts.orderBy(F.desc("total"), F.asc("term")).limit(size).collect()]


def vocabulary_counts(docs: DataFrame, key: str, terms: "F.Column", vocabulary: list[str]) -> DataFrame:
    """(key, counts: array of (term, tf)) -- each row's vocabulary terms counted inside
    the row, so no (document, term) pair is ever shuffled.

    Rows without a vocabulary term keep an empty array: a filter on it would be pushed
    below the projection and evaluate the tokens again for every term. The counted rows
    are written once, as the idf and the weights both read them."""
    kept = docs.select(key, F.filter(terms, lambda t: t.isin(vocabulary) if vocabulary else F.lit(False)).alias("_k"))
    counts = F.transform(F.array_distinct("_k"), lambda t: F.struct(
        t.alias("term"), (F.size("_k") - F.size(F.array_remove("_k", t))).cast("long").alias("tf")))
    ensure_checkpoint_dir(docs.sparkSession)
    return kept.select(key, counts.alias("counts")).checkpoint()


def inverse_frequencies(counted: DataFrame, n_docs: int, smooth: float) -> dict[str, float]:
    """ln((N + 1) / (df + 1)) + ``smooth`` per vocabulary term."""
    rows = counted.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")) \
        .select("term", (F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1.0)) + smooth).alias("idf")).collect()
    return {r["term"]: r["idf"] for r in rows}


def _scored(docs, key, terms, size, smooth, vocabulary=None):
    vocabulary = top_vocabulary(docs, terms, size) if vocabulary is None else vocabulary
    counted = vocabulary_counts(docs, key, terms, vocabulary)
    idf = inverse_frequencies(counted, docs.count(), smooth)
    if not idf:
        return counted.select(key, F.array().cast("array<struct<term:string,tf:bigint,w:double>>").alias("_s"))
    weight = F.create_map(*[x for t, w in idf.items() for x in (F.lit(t), F.lit(w))])
    return counted.select(key, F.transform("counts", lambda c: F.struct(
        c["term"].alias("term"), c["tf"].alias("tf"), (c["tf"] * F.element_at(weight, c["term"])).alias("w"))).alias("_s"))


def tfidf(docs: DataFrame, key: str = "doc_id", text_col: str = "text", vocab_size: int = 100,
          stop_words=None) -> DataFrame:
    """C11, relational form: tf * ln((N + 1) / (df + 1)) over a top-``vocab_size`` vocabulary."""
    rows = _scored(docs, key, unigrams(text_col, stop_words), vocab_size, 0.0)
    return rows.select(key, F.inline("_s").alias("term", "tf", "tfidf"))


def tfidf_maps(docs: DataFrame, key: str = "doc_id", text_col: str = "text", vocab_size: int = 100,
               stop_words=None) -> DataFrame:
    """C11 for one map per key, (key, tfidf_terms): the weights of all texts of a key are added
    term by term in one aggregate of ``vocab_size`` sums, combined before its only shuffle."""
    vocabulary = top_vocabulary(docs, unigrams(text_col, stop_words), vocab_size)
    rows = _scored(docs, key, unigrams(text_col, stop_words), vocab_size, 0.0, vocabulary)
    weights = rows.select(key, F.map_from_entries(F.transform("_s", lambda c: F.struct(c["term"], c["w"]))).alias("_m"))
    sums = [F.sum(F.element_at("_m", F.lit(t))).alias(f"_w{i}") for i, t in enumerate(vocabulary)]
    if not sums:
        return weights.select(key, F.lit(None).cast("map<string,double>").alias("tfidf_terms")).limit(0)
    cells = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"_w{i}").alias("w")) for i, t in sorted(enumerate(vocabulary), key=lambda x: x[1])])
    return weights.groupBy(key).agg(*sums).select(key, F.filter(cells, lambda c: c["w"].isNotNull()).alias("_c")) \
        .filter(F.size("_c") > 0).select(key, F.map_from_entries("_c").alias("tfidf_terms"))


def tfidf_ngrams(docs: DataFrame, key: str = "doc_id", text_col: str = "text", max_features: int = 50,
                 stop_words=None) -> DataFrame:
    """uni+bigram TF-IDF, top ``max_features`` terms by corpus count, smoothed
    idf = ln((1 + N) / (1 + df)) + 1, each document's vector scaled to unit length
    -- the length is computed inside the row."""
    found = frequent_ngrams(docs, key, text_col, max_features, stop_words)
    if found is not None:
        rows = _scored(found[0], key, found[1], max_features, 1.0, found[2])
    else:
        terms = unigrams_and_bigrams(text_col, stop_words)
        rows = _scored(docs, key, terms, max_features, 1.0, counted_vocabulary(docs, terms, max_features))
    norm = F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return rows.withColumn("_n", norm).select(key, "_n", F.inline("_s").alias("term", "tf", "_w")) \
        .select(key, "term", "tf", (F.col("_w") / F.col("_n")).alias("tfidf"))


def tfidf_pipeline(vocab_size: int = 100, input_col: str = "text"):
    """C11, Spark ML form: RegexTokenizer -> StopWordsRemover -> CountVectorizer -> IDF."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StopWordsRemover
    return Pipeline(stages=[
        RegexTokenizer(inputCol=input_col, outputCol="_tokens", pattern="\\W"),
        StopWordsRemover(inputCol="_tokens", outputCol="_filtered"),
        CountVectorizer(inputCol="_filtered", outputCol="_tf", vocabSize=vocab_size),
        IDF(inputCol="_tf", outputCol="tfidf_features"),
    ])


# ------------------------------------------------------------- long dictionaries

HEAD = 8  # characters at which a longer name is looked for first
LITERAL_GRAMS = 20_000  # names, the first of the list, that travel inside the plan
MOST_BITS = 27  # a filter has at most 1 << MOST_BITS bits
GROUP = 1 << 18  # characters of texts that are looked through at a time
PROBES = 4  # bits of the filter that stand for a name
_BASE = 0x9E3779B97F4A7C15
_ODD = (0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class _Stretches:
    """Hashes of stretches of joined texts, by prefix sums: the same characters have the same hash wherever they stand."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if len(codes) >= len(self.up):
            _Stretches.up, _Stretches.down = (np.cumprod(np.r_[np.uint64(1), np.full(len(codes), b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.r_[np.uint64(0), np.cumsum((codes + np.uint64(1)) * self.up[:len(codes)])]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def hashes(self, at: np.ndarray, length, whole: bool) -> np.ndarray:
        """A number for each stretch, as a whole name or as the beginning of one."""
        if isinstance(at, slice):  # at every place
            last = max(0, len(self.sums) - length)
            h = self.sums[length:] - self.sums[:last]
            h *= self.down[:last]
        else:
            h = (self.sums[at + length] - self.sums[at]) * self.down[at]
        h += np.uint64(whole)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _slots(h: np.ndarray, turn: int, bits: int) -> np.ndarray:
    """The ``turn``-th of the PROBES bits that stand for a hash."""
    return ((h ^ (h >> np.uint64(32))) * np.uint64(_ODD[turn]) >> np.uint64(64 - bits)).astype(np.int64)


def _name_slots(names: list[str], bits: int) -> np.ndarray:
    s = _Stretches(names)
    h = np.r_[s.hashes(s.starts, s.lengths, True), s.hashes(s.starts[s.lengths > HEAD], HEAD, False)]
    return np.concatenate([_slots(h, k, bits) for k in range(PROBES)])


def _held_names(texts: list[str], lengths: list[int], filled: np.ndarray, bits: int) -> list[set[str]]:
    """For every text its stretches that may be names: all that are, and few others."""
    s = _Stretches(texts)
    out: list[set[str]] = [set() for _ in texts]
    end = np.repeat(s.ends, s.lengths)

    def passing(at, h, n):
        for k in range(PROBES):
            slot = _slots(h, k, bits)
            on = np.flatnonzero((filled[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
            at, h = on if at is None else at[on], h[on]
        return at[at + n <= end[at]]

    begins = None
    for n in lengths:
        if n > HEAD and begins is None:
            begins = passing(None, s.hashes(slice(None), HEAD, False), HEAD)
        if n > HEAD:
            begins = begins[begins + n <= end[begins]]
            if not len(begins):
                break
            at = passing(begins, s.hashes(begins, n, True), n)
        else:
            at = passing(None, s.hashes(slice(None), n, True), n)
        row = np.searchsorted(s.ends, at, "right")
        for r, p in zip(row.tolist(), (at - s.starts[row]).tolist(), strict=True):
            out[r].add(texts[r][p:p + n])
    return out


def name_filter(index: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of every listed name and of the beginning of every long one: 32 to 64 bits a name, at most 16 MB in all."""
    bits = min(MOST_BITS, max(10, (32 * index.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_name_slots(b.column(0).to_pylist(), bits))], names=["slot"])

    words = index.select("low").mapInArrow(run, "slot bigint").groupBy(F.shiftright("slot", 6).alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("held")).toArrow()
    filled = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    filled[words["word"].to_numpy()] = words["held"].to_numpy().view(np.uint64)
    return filled, bits


def names_asked(texts: DataFrame, index: DataFrame, first: list[str]) -> DataFrame:
    """(key, low): the stretches of every text (key, text) that may be listed names. A text that holds one of ``first``,
    the first names of the list in order, sends the foremost of them alone, as no other name can go before it."""
    filled, bits = name_filter(index)
    lengths = sorted(r[0] for r in index.select(F.length("low")).distinct().collect())
    place = {n: i for i, n in enumerate(first)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in rows])
            cuts = [0, *(np.flatnonzero(np.diff(ends // GROUP)) + 1).tolist(), len(rows)]
            for lo, hi in pairwise(cuts):
                held = _held_names(rows[lo:hi], lengths, filled, bits)
                held = [[first[min(known)]] if (known := [place[n] for n in found if n in place]) else list(found) for found in held]
                counts = np.array([len(h) for h in held], np.int64)
                at = pa.array(np.repeat(np.arange(lo, hi), counts))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([n for h in held for n in h], pa.string())], names=["key", "low"])

    return texts.select("key", "text").mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, low string")


def listed_names(docs: DataFrame, names: DataFrame, key: str = "doc_id", text_col: str = "text", name_col: str = "name",
                 priority_col: str = "priority", literal_grams: int = LITERAL_GRAMS) -> DataFrame:
    """C8 for dictionaries of any length: (key, name) of the first listed name that the text contains, case ignored.

    Every stretch of a text that is as long as some name is looked up in a filter of bounded size, and what passes is
    joined with the list by its characters, so that texts and list only meet where a name is held. First is the smallest
    priority, ties by name; null and empty names count for nothing; texts without a name have no row. Rows with one key are one text's parts.

    The first ``literal_grams`` names of the list go along with the filter: a text that holds one of them sends that
    name alone, and any other text all that it holds. The result is the same for any number of them."""
    listed = names.select(F.lower(name_col).alias("low"), F.struct(F.col(priority_col).alias("priority"), F.col(name_col).alias("name")).alias("first")).filter("low <> ''")
    index = written(listed.groupBy("low").agg(F.min("first").alias("first")), "names")
    foremost = [r["low"] for r in index.orderBy("first").limit(literal_grams).collect()] if literal_grams else []
    texts = docs.select(F.col(key).alias("key"), F.lower(text_col).alias("text")).filter(F.col("text") != "")
    hits = names_asked(texts, index, foremost).join(index, "low")
    return hits.groupBy("key").agg(F.min("first").alias("first")).select(F.col("key").alias(key), "first.name")
