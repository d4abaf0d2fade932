"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendlens.llm import piece_viterbi as pv
from lendlens.llm import quality_rules as qr
from lendlens.llm import simhash_dedup as sd
from lendlens.llm import token_files as tf
from lendlens.llm import best_fit_packing as bp
from lendlens.llm import chat_format as cf
from lendlens.llm import conversation_trie as ct
from lendlens.llm import license_scan as ls
from lendlens.llm import line_dedup as ld
from lendlens.llm import metric_search as ms
from lendlens.llm import periodic_runs as pr
from lendlens.llm import substring_dedup as sub
from lendlens.llm import url_rules as ur
from lendlens.llm.common import documents, joined, shared_folder, staged

QUERIES = {}
SQL = {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@register("op6_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
wins AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {'at': i, 'x': words[i:i + 2]})) AS win FROM w),
hit AS (SELECT doc_id, win.at AS pos FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win.x) > 1),
rep AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM hit, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
        + (CASE WHEN word_chars > 25 * n_words THEN 8 ELSE 0 END)
        + (CASE WHEN 10 * word_chars < 15 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 7 * n_lines THEN 32 ELSE 0 END) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines, CAST(failed AS BIGINT) AS failed,
       failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM f
""")
def op6_quality_rules(spark, sf_dir):
    """The ledger of every document, with the verdicts of the base and the standard policy."""
    book = qr.ledger(documents(spark, sf_dir))
    judged = qr.apply_policy(qr.apply_policy(book, qr.BASE, "base_kept"), qr.STANDARD, "kept")
    return judged.select(F.col("id").alias("doc_id"), *qr.MEASURES, "failed",
                         (~F.col("base_kept")).alias("base_failed"), "kept")


@register("op7_simhash_dedup")
def op7_simhash_dedup(spark, sf_dir):
    """Every document's fingerprint and the smallest doc_id that its links reach."""
    found = sd.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@register("op2_token_files")
def op2_token_files(spark, sf_dir):
    """Token ids of every document, written to token files and read back."""
    import public_tokenizers

    path = shared_folder(spark, "token-files")
    tf.write_corpus(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tf.read_token_files(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op8_metric_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op8_metric_search(spark, sf_dir):
    """The five best integer inner products of every fiftieth vector against all others."""
    rows = documents(spark, sf_dir, "embeddings").filter(ms.usable("embedding")).select("vec_id", ms.quantised("embedding").alias("vec"))
    return ms.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@register("op3_url_rules")
def op3_url_rules(spark, sf_dir):
    """The verdict on every page's url. Pages take the label of the document with their
    id: block where it is of low quality or toxic."""
    labels = documents(spark, sf_dir, "labels").filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL") \
        .select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow").alias("verdict"))
    return ur.judge(documents(spark, sf_dir, "pages"), labels, URL_RULES).withColumnRenamed("id", "page_id")


WORDS = r"[^\x20\x09-\x0D]+"


def packing_input(docs):
    """Documents with their length in words and their cluster of near copies, null for a null text."""
    fps = staged(sd.fingerprints(docs, carried={
        "source": F.col("source"), "size": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)), "known": F.col("text").isNotNull()}), "packing-input")
    root = sd.roots(fps, F.col("id")).select("fp", "rows", "root")
    return joined(fps, root, ["fp"], fps.count()).select(F.col("id").alias("doc_id"), "source", "size", F.when(F.col("known"), F.col("root")).alias("cluster"))


@register("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    """Every document's pieces in sequences of 2048 words, with no source and no two near copies in one sequence."""
    return bp.pack(packing_input(documents(spark, sf_dir)), capacity=2048).withColumnRenamed("id", "doc_id")


@register("op5_chat_format", r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST) AS turns, count(*) AS n FROM t GROUP BY conv_id),
kept AS (SELECT conv_id FROM c WHERE NOT EXISTS (
  SELECT 1 FROM c AS o WHERE o.n >= c.n AND o.turns[1:c.n] = c.turns AND (o.n > c.n OR o.conv_id < c.conv_id))),
r AS (SELECT conv_id, coalesce(CAST(floor(turn / 256.0) AS BIGINT), -72057594037927936) AS part, turn,
        '<|im_start|>' || role || chr(10) || regexp_replace(text, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || '<|im_end|>' || chr(10) AS line
      FROM t WHERE conv_id IN (SELECT conv_id FROM kept))
SELECT conv_id, part, count(*) AS n_turns, string_agg(line, '' ORDER BY turn NULLS FIRST) AS text FROM r GROUP BY conv_id, part
""")
def op5_chat_format(spark, sf_dir):
    """The maximal conversations, rendered."""
    return cf.format_chats(documents(spark, sf_dir, "conversations"))


@register("op1_line_dedup")
def op1_line_dedup(spark, sf_dir):
    """Every line with a word: its class (the place of the class's first line), its links and whether it stays."""
    found = ld.line_classes(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.col("class.id").alias("class_doc_id"),
                        F.col("class.line_no").cast("long").alias("class_line_no"), "n_copies", "n_links", ld.is_first().alias("kept"))


@register("op9_piece_viterbi")
def op9_piece_viterbi(spark, sf_dir):
    """Every document encoded into pieces and decoded again: the ids' count and checksum, and whether the text came back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the text's checksum travels with the row, so that the decoded text can be compared without a join
    coded = pv.round_trip(docs, path)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"),
                        F.length("decoded").cast("long").alias("n_chars"), (F.col("decoded") == F.col("text")).alias("same_text"))


@register("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    """The licence families that every document names, with the number and the first line of its licence passages."""
    docs = documents(spark, sf_dir)
    classifier, _ = ls.train(docs)
    found = ls.scan_licenses(docs, classifier)
    return found.select(F.col("id").alias("doc_id"), F.size("spans").cast("long").alias("n_passages"),
                        F.array_join(F.array_sort(F.array_distinct(F.col("spans.family"))), ",").alias("families"),
                        F.get("spans.line_no", F.lit(0)).alias("first_line"))


def looped(text, doc_id):
    """Every tenth document by the hash of its id gets a loop: from a word on, its words repeat with a period (both by the hash)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(ws):
        n = F.size(ws)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(WORDS)), F.element_at(F.transform(F.array(words), loop), 1)).otherwise(text)


@register("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """The runs of every document, its longest run and what is left when each run is cut to its first period."""
    docs = documents(spark, sf_dir).select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = pr.periodic_runs(docs)
    first = F.get(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.sign(b["length"] - a["length"]))
                               .when(a["start"] != b["start"], F.sign(a["start"] - b["start"])).otherwise(F.sign(a["period"] - b["period"])).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("id", "n_words", "runs", "collapsed", first.alias("first"))
    return rows.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "first.start", "first.length", "first.period",
                       F.floor(1000 * F.col("first.length") / F.col("first.period")).cast("long").alias("exponent_milli"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


# windows start at a word's place; the text's words before and after it decide nothing
@register("op12_fm_substring_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, unnest(range(1, len(words) - 33)) AS pos, words FROM d WHERE len(words) >= 35),
x AS (SELECT r, pos, sha256(array_to_string(words[pos:pos + 34], ' ')) AS h FROM w),
c AS (SELECT r, pos FROM x QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT r, list_distinct(flatten(list(range(pos, pos + 35)))) AS gone FROM c GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda v, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
""")
def op12_fm_substring_dedup(spark, sf_dir):
    """Every document's words, how many lie in a 35-word passage that occurs elsewhere, and what is left."""
    found = sub.drop_repeated(documents(spark, sf_dir), window=35)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def rebuilt_turns(turns):
    """(turns, convs) of the rebuilt conversations: the first h turns of conversation c - c % 5, then c's own after its first h.

    A conversation of many turns is looked up by chunks of them, so its rows meet their length in many tasks."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("n_base"))
    convs = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h")).join(bases, "base", "left")
    convs = staged(convs.select("conv_id", "own", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head")), "rebuilt-convs")
    first = turns.filter("k <= 8").withColumnRenamed("conv_id", "base")
    heads = convs.select("conv_id", "base", "head").join(first, "base").filter("k <= head").select("conv_id", F.col("k").alias("pos"), "role", "text")
    chunks = convs.filter("own > h").select("conv_id", "h", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / ct.CHUNK))).alias("chunk"))
    tails = turns.withColumn("chunk", F.floor(F.col("k") / ct.CHUNK)).join(chunks, ["conv_id", "chunk"]).filter("k > h") \
        .select("conv_id", (F.col("head") + F.col("k") - F.col("h")).alias("pos"), "role", "text")
    return heads.unionByName(tails), convs.select("conv_id")


@register("op11_conversation_trie", """
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hs AS (SELECT conv_id, turns, (SELECT list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
         lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)))
         AS crc FROM t),
hh AS (SELECT conv_id, turns, xor(crc, 4294967295::BIGINT) % 9 AS h FROM hs),
c AS (SELECT hh.conv_id, list_concat(coalesce(b.turns[1:hh.h], []), hh.turns[hh.h + 1:]) AS turns FROM hh LEFT JOIN t AS b ON b.conv_id = hh.conv_id - hh.conv_id % 5),
x AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM c),
p AS (SELECT conv_id, n, depth, md5(to_json(turns[1:depth])::VARCHAR) AS id, CASE WHEN depth > 0 THEN md5(to_json(turns[1:depth - 1])::VARCHAR) END AS up,
        CASE WHEN depth > 0 THEN strlen(turns[depth].text) ELSE 0 END AS bytes FROM x),
nodes AS (SELECT depth, id, any_value(up) AS up, any_value(bytes) AS bytes, count(*) AS n_convs, min(conv_id) AS conv_id,
            coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends FROM p GROUP BY depth, id),
kids AS (SELECT depth - 1 AS depth, up AS id, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
whole AS (SELECT a.depth, a.id, sum((d.n_convs - 1) * d.bytes) AS saved_tokens, count(*) FILTER (WHERE k.id IS NULL) AS n_leaves
          FROM nodes d JOIN p a ON a.conv_id = d.conv_id AND a.depth <= d.depth LEFT JOIN kids k ON k.depth = d.depth AND k.id = d.id GROUP BY a.depth, a.id)
SELECT nodes.conv_id, nodes.depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN whole USING (depth, id) LEFT JOIN kids USING (depth, id) LEFT JOIN nodes AS parent ON parent.depth = nodes.depth - 1 AND parent.id = nodes.up
""")
def op11_conversation_trie(spark, sf_dir):
    """The prefix trie of the rebuilt conversations."""
    turns = staged(ct.numbered(documents(spark, sf_dir, "conversations")), "numbered-turns")
    return ct.prefix_trie(*rebuilt_turns(turns))
