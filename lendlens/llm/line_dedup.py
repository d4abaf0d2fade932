"""Line dedup by a segment-partition edit join.

Two lines link when their edit distance is at most ``edits``. Every line is
cut into edits + 1 segments; a line within that distance holds one of them
unchanged, at nearly the same place. So each line files its segments (by
length, segment number and text) and probes, for every length it can link to,
the few substrings of its own that can match a segment there. Lines that meet
under a key are compared by a banded bit-parallel edit distance, after what they share at both ends
is cut off. A key of many lines is split over many tasks.

Everything runs as DataFrame expressions. Exact copies are merged before the
join, and texts are fetched only for lines that met another line. Of linked lines a maximal set
stays whose members do not link; every line that goes links to one of them.

Lines too short for selective segments meet under what is left of them after
up to ``edits`` deletions: two lines within that many edits share such a rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import components, joined, staged

WORD = r"[^\x20\x09-\x0D]"
EDITS = 2
MIN_CHARS = 12  # lines this long meet by segments, pairs with a shorter line by deletions
BROADCAST_LINES = 200_000
CROWD = 512  # askers of a key that one task compares with its filed lines


def places(edits: int) -> list[tuple[int, int, int]]:
    """(shorter, segment, shift) of the keys that a line asks for: lengths from its own down
    by ``edits``, and per segment the starts that leave enough edits on both sides of it.
    The keys with neither are those it is filed under."""
    return [(d, i, shift) for d in range(edits + 1) for i in range(edits + 1)
            for shift in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1)]


def segment(line: str, m: str, i: str, t: str, edits: int) -> str:
    """Segment ``i`` of a line of ``m`` characters, read ``t`` further on; the last segments take what does not divide evenly."""
    k = edits + 1
    return f"substring({line}, {i} * int({m} div {k}) + greatest({i} - {k} + {m} % {k}, 0) + {t} + 1, int({m} div {k}) + if({i} >= {k} - {m} % {k}, 1, 0))"


def keyed(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(line_id, key, place): a row per line and place. A key stands for a length, a segment's number and its text."""
    cells = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(n).alias("place")) for n, (d, i, t) in enumerate(places(edits))])
    rows = lines.select("line_id", "line", "n", F.explode(cells).alias("p")) \
        .select("line_id", "line", (F.col("n") - F.col("p.d")).alias("m"), "p.i", "p.t", "p.place").filter(F.col("m") >= min_chars)
    return rows.select("line_id", F.expr(f"xxhash64(m, i, {segment('line', 'm', 'i', 't', edits)})").alias("key"), F.col("place").cast("byte").alias("place"))


def within(a: str, b: str, edits: int) -> Column:
    """Whether two character arrays, both longer than ``edits``, are within ``edits`` edits.

    Hyyro's banded bit-parallel recurrence (2003): bit t of a word stands for
    row j - edits + t of column j, so one small integer holds the whole band.
    The distance is followed along the band's lower edge to the last row and
    then along that row; it can only shrink there, by 2 * edits at most.
    """
    wide = 2 * edits + 1
    full = (1 << wide) - 1
    match = " + ".join(f"CASE WHEN get({a}, _j + {t - edits - 1}) = get({b}, _j - 1) THEN {1 << t} ELSE 0 END" for t in range(wide))
    d0 = f"((((_x & _s.vp) + _s.vp) ^ _s.vp) | _x | _s.vn) & {full}"
    hp, hn = f"((_s.vn | ~(_d0 | _s.vp)) & {full})", "(_d0 & _s.vp)"
    along = f"CAST(size({a}) - _s.j + {edits} AS INT)"
    moved = f"CASE WHEN _s.j <= size({a}) - {edits} THEN 1 - shiftright(_d0, {wide - 1}) " \
            f"ELSE (shiftright({hp}, {along}) & 1) - (shiftright({hn}, {along}) & 1) END"
    new = f"named_struct('j', _s.j + 1, 'vp', ({hn} | ~(shiftright(_d0, 1) | {hp})) & {full}, 'vn', shiftright(_d0, 1) & {hp}, 'd', _s.d + {moved})"
    start = f"named_struct('j', 1, 'vp', {full & ~((1 << edits) - 1)}, 'vn', 0, 'd', {edits})"
    return F.expr(f"""abs(size({a}) - size({b})) <= {edits} AND aggregate(
        transform(sequence(1, size({b})), _j -> {match}), {start},
        (_s, _x) -> CASE WHEN _s.d > {3 * edits} THEN _s ELSE element_at(transform(array({d0}), _d0 -> {new}), 1) END,
        _s -> _s.d <= {edits})""")


def letters(line: str) -> Column:
    """The parity of the count of every character, modulo 64: one edit changes two bits at most."""
    return F.expr(f"aggregate(split({line}, ''), 0L, (_s, _c) -> _s ^ shiftleft(1L, ascii(_c) % 64))")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, line_no, line) of every line that holds a word; th tells apart rows with equal ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return rows.filter(F.col("line").rlike(WORD))


def _identity(line: str = "line") -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), F.col(line)).alias("h2")]


def trimmed(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """``pairs`` with the texts ``a`` and ``b`` cut at both ends where they agree; a few more characters than ``edits`` stay.

    What agrees at an end adds nothing to the distance, and lines of one template agree nearly everywhere."""
    for side, keep in (("left({}, {})", "substring({0}, _cut + 1)"), ("right({}, {})", "left({0}, length({0}) - _cut)")):
        for k in (512, 256, 128, 64, 32, 16, 8, 4, 2, 1):
            same = (F.length(a) > k + edits) & (F.length(b) > k + edits) & (F.expr(side.format(a, k)) == F.expr(side.format(b, k)))
            pairs = pairs.withColumn("_cut", F.when(same, k).otherwise(0))
            pairs = pairs.withColumns({c: F.when(F.col("_cut") > 0, F.expr(keep.format(c))).otherwise(F.col(c)) for c in (a, b)})
    return pairs.drop("_cut")


def meetings(filed: DataFrame, asked: DataFrame, crowd: int) -> DataFrame:
    """Rows of ``asked`` joined with those of ``filed`` under their key. Both know in ``rows`` how many rows the key
    has: the askers of a crowded key are dealt out, and its filed rows go to each of their parts."""
    parts = F.ceil(F.col("rows") / crowd)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("b_line_id"), parts)).drop("rows")
    filed = filed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("rows")
    return filed.join(asked, ["key", "part"])


def met(rows: DataFrame, filed: Column, few: int) -> DataFrame:
    """The ``rows`` (key, line_id, ...) of keys of several rows, a filed one among them, with the key's number of ``rows``.

    Keys are counted with partial sums, so a crowded key is no crowded task. Those wanted go to all tasks
    if there are at most ``few``, and by a join that splits crowded keys otherwise."""
    # one sum holds both numbers; a line that meets only itself is found out later
    both = F.sum(F.when(filed, F.lit((1 << 40) + 1)).otherwise(F.lit(1)).cast("long"))
    keys = rows.groupBy("key").agg(both.alias("both")).filter(f"both > {(1 << 40) + 1}").select("key", (F.col("both") % (1 << 40)).alias("rows"))
    keys = staged(keys, "met-keys")
    if keys.count() <= few:
        return rows.join(F.broadcast(keys), "key")
    return joined(rows, keys, ["key"], rows.count())


def links(distinct: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, broadcast_lines: int = BROADCAST_LINES, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: every pair of different lines within ``edits`` edits.

    Pairs of lines of ``min_chars`` or more are found by segments, those with a shorter line
    by deletions. A pair that meets under several keys is compared under the first alone. ``distinct`` holds
    (line_id, line), each line once; it is read several times, so pass a table.
    """
    if min_chars < 2 * edits + 2:
        raise ValueError("lines this short cannot be cut into segments")
    long = distinct.select("line_id", "line", F.length("line").alias("n")).filter(F.col("n") >= min_chars)
    at = places(edits)
    own = F.col("place").isin([i for i, (d, _, t) in enumerate(at) if d == 0 and t == 0])
    found = staged(met(staged(keyed(long, edits, min_chars), "line-keys", "snappy"), own, broadcast_lines), "met")
    wanted = staged(found.select("line_id").distinct(), "met-lines")
    small = wanted.count() <= broadcast_lines
    texts = long.join(F.broadcast(wanted) if small else wanted, "line_id", "left_semi") \
        .select("line_id", "line", "n", letters("line").alias("letters"))
    rows = found.join(staged(texts, "met-texts"), "line_id")
    left = rows.filter(own).select("key", "rows", *[F.col(c).alias(f"a_{c}") for c in ("line_id", "line", "n", "letters")])
    right = rows.select("key", "rows", "place", *[F.col(c).alias(f"b_{c}") for c in ("line_id", "line", "n", "letters")])
    # under this place the asker looks for lines shorter by exactly its d
    shorter = F.element_at(F.array(*[F.lit(d) for d, _, _ in at]), F.col("place") + 1)
    once = (F.col("b_n") - F.col("a_n") == shorter) & ((F.col("a_n") < F.col("b_n")) | (F.col("a_line_id") < F.col("b_line_id")))
    near = F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2 * edits
    earlier = [f"(place > {q} AND b_n - a_n = {d} AND {segment('a_line', 'a_n', str(i), '0', edits)} = {segment('b_line', 'a_n', str(i), str(t), edits)})"
               for q, (d, i, t) in enumerate(at) if q < len(at) - 1]
    pairs = meetings(left, right, crowd).filter(once & near).filter("NOT (" + " OR ".join(earlier) + ")")
    pairs = trimmed(pairs.select("a_line_id", "b_line_id", "a_line", "b_line"), "a_line", "b_line", edits)
    # the explode keeps the filter from being pushed below the cuts, which it would repeat for each use of a text
    chars = F.explode(F.array(F.struct(F.split("a_line", "").alias("a"), F.split("b_line", "").alias("b")))).alias("chars")
    pairs = pairs.select("a_line_id", "b_line_id", chars).filter(within("chars.a", "chars.b", edits))
    # a key is a hash, and a line may hold one segment twice: what is left of repeated pairs goes here
    pairs = pairs.select(F.least("a_line_id", "b_line_id").alias("a"), F.greatest("a_line_id", "b_line_id").alias("b")).distinct()
    return pairs.unionAll(short_links(distinct, edits, min_chars, broadcast_lines, crowd))


def rests(line: str, edits: int) -> Column:
    """What is left of a line after every choice of up to ``edits`` deletions."""
    shorter = "array_distinct(flatten(transform({}, _x -> transform(sequence(1, greatest(length(_x), 1)), " \
              "_p -> concat(substring(_x, 1, _p - 1), substring(_x, _p + 1))))))"
    level = every = f"array({line})"
    for _ in range(edits):
        level = shorter.format(level)
        every = f"array_union({every}, {level})"
    return F.expr(every)


def short_links(distinct: DataFrame, edits: int, min_chars: int, broadcast_lines: int = BROADCAST_LINES, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: every pair within ``edits`` edits whose shorter line has less than ``min_chars``."""
    short = distinct.select("line_id", "line", F.length("line").alias("n")).filter(F.col("n") < min_chars + edits)
    keys = staged(short.select("line_id", "line", "n", F.explode(F.transform(rests("line", edits), lambda x: F.xxhash64(x))).alias("key")), "rests")
    rows = met(keys, F.col("n") < min_chars, broadcast_lines)
    left, right = [rows.select("key", "rows", *[F.col(c).alias(f"{side}_{c}") for c in ("line_id", "line", "n")]) for side in "ab"]
    near = (F.least("a_n", "b_n") < min_chars) & (F.col("a_line_id") < F.col("b_line_id")) & (F.levenshtein("a_line", "b_line", edits) >= 0)
    return meetings(left, right, crowd).filter(near).select(F.col("a_line_id").alias("a"), F.col("b_line_id").alias("b")).distinct()


def repeated(found: DataFrame, names: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(line_id, kept_id): the lines that go, each with a line that it links to and that stays.

    ``found`` holds links (a, b), ``names`` (line_id, h) an order of the lines by hash. A line stays if it links to no line
    that comes before it and stays, so the lines that stay are linked to none another and every other line has a link to one. Each round
    settles all lines before which nothing undecided is left; a random order needs a number of rounds
    that grows with the logarithm of the links."""
    order = F.struct("h", "line_id")
    ends = found.join(names.select(F.col("line_id").alias("a"), order.alias("oa")), "a").join(names.select(F.col("line_id").alias("b"), order.alias("ob")), "b")
    first = F.col("oa") < F.col("ob")
    edges = staged(ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")), "undecided")
    gone = edges.select(F.col("v").alias("line_id"), F.col("u").alias("kept_id")).limit(0)
    for _ in range(max_rounds):
        if not edges.head(1):
            return gone
        sides = edges.groupBy(F.col("u").alias("n")).agg(F.lit(0).alias("behind")).unionAll(edges.groupBy(F.col("v").alias("n")).agg(F.lit(1).alias("behind")))
        heads = sides.groupBy("n").agg(F.max("behind").alias("behind")).filter("behind = 0").select(F.col("n").alias("u"))
        lost = staged(edges.join(heads, "u").groupBy(F.col("v").alias("line_id")).agg(F.min("u").alias("kept_id")), "repeated-lines")
        gone = gone.unionAll(lost)
        out = lost.select("line_id")
        edges = staged(edges.join(out.withColumnRenamed("line_id", "u"), "u", "left_anti").join(out.withColumnRenamed("line_id", "v"), "v", "left_anti"), "undecided")
    raise RuntimeError(f"lines did not settle in {max_rounds} rounds")


def line_links(docs: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every line with its place; the distinct lines (line_id, line, first, n_copies); their links; the lines that go."""
    every = lines(docs, id_col, text_col)
    distinct = staged(every.groupBy("line").agg(F.min(F.struct("id", "th", "line_no")).alias("first"), F.count("*").alias("n_copies"))
                      .withColumn("line_id", F.monotonically_increasing_id()), "lines")
    found = staged(links(distinct.select("line_id", "line"), edits, min_chars), "line-links")
    linked = found.select(F.col("a").alias("line_id")).unionAll(found.select(F.col("b").alias("line_id"))).distinct()
    names = staged(distinct.join(linked, "line_id", "left_semi").select("line_id", F.xxhash64("line").alias("h")), "linked-names")
    return every, distinct, found, repeated(found, names)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, line_no, chars, n_copies, n_links, class, kept_at): every line with a word of every row.

    ``class`` is the place (id, th, line_no) where the first line of the class
    stands; lines are in one class if links or equality join them. ``n_links``
    counts the different texts that the line links to, ``n_copies`` the places
    with exactly its text. ``kept_at`` is the first place of the line's text, or null if the text goes
    because it links to one that stays (see ``repeated``). Lines are split
    at newlines and compared whole; lines without a word, and null texts,
    have no row. Null ids come first in the order of places. Rows with equal ids
    are told apart by ``th``, a hash of the text; equal rows share their places.
    An empty table gives an empty result; other columns are not read.
    """
    every, distinct, found, gone = line_links(docs, id_col, text_col, edits, min_chars)
    degree = found.select(F.col("a").alias("line_id")).unionAll(found.select(F.col("b").alias("line_id"))) \
        .groupBy("line_id").agg(F.count("*").alias("n_links"))
    graph = components(found).withColumnRenamed("node", "line_id")
    linked = distinct.select("line_id", "first").join(graph, "line_id")
    lead = linked.groupBy("component").agg(F.min("first").alias("lead"))
    linked = linked.join(lead, "component").join(degree, "line_id").join(gone, "line_id", "left") \
        .select("line_id", "lead", "n_links", F.col("kept_id").isNotNull().alias("gone"))
    linked = staged(linked, "linked-lines")
    named = distinct.select("line_id", "first", "n_copies", *_identity()).join(linked, "line_id", "left") \
        .select("h1", "h2", F.col("n_copies").alias("rows"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("lead", "first").alias("class"),
                F.when(F.col("gone"), F.lit(None)).otherwise(F.col("first")).alias("kept_at"))
    named = staged(named, "named-lines")
    occurrences = every.select("id", "th", "line_no", F.length("line").alias("chars"), *_identity())
    return joined(occurrences, named, ["h1", "h2"], _total(named)) \
        .select("id", "th", "line_no", "chars", F.col("rows").alias("n_copies"), "n_links", "class", "kept_at")


def _total(named: DataFrame) -> int:
    return named.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def is_first() -> Column:
    """Whether a row of line_classes stays: it is the first place of its text, and the text links to no other that stays."""
    return F.struct("id", "th", "line_no").eqNullSafe(F.col("kept_at"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
                        min_chars: int = MIN_CHARS, max_loss: float | None = 0.5) -> DataFrame:
    """The rows of ``docs`` without the lines that repeat a line that stays, exactly or within ``edits`` edits of it, in any row.

    With ``max_loss`` None this holds for every row; a row with no line left
    gets an empty text. Otherwise a row that would lose more than ``max_loss`` of
    its line characters stays as it is. Rows without repeated lines, and null
    texts, are not touched; no row is dropped. Rows equal in id and text share
    their decisions. An empty table gives an empty one; columns of any names keep their values.
    """
    every, distinct, _, gone = line_links(docs, id_col, text_col, edits, min_chars)
    named = distinct.join(gone, "line_id", "left") \
        .select(*_identity(), F.col("n_copies").alias("rows"), F.when(F.col("kept_id").isNull(), F.col("first")).alias("kept_at"))
    named = staged(named.filter("rows > 1 OR kept_at IS NULL"), "named-lines")
    occurrences = every.select("id", "th", "line_no", F.length("line").alias("chars"), *_identity())
    found = joined(occurrences, named, ["h1", "h2"], _total(named)).filter(~is_first())
    lost = found.groupBy("id", "th").agg(F.sum("chars").alias("lost"), F.collect_set("line_no").alias("drop"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("key"), F.xxhash64(text_col).alias("hash"))
    rows = rows.join(lost, rows["key"].eqNullSafe(lost["id"]) & (rows["hash"] == lost["th"]), "left")
    # what a row's lines with a word add up to is read off its own text
    cells = F.transform(F.split(F.col("row")[text_col], "\n", -1), lambda x, i: F.struct(x.alias("line"), F.array_contains("drop", i).alias("drop")))
    judged = rows.withColumn("cells", F.when(F.col("drop").isNotNull(), cells))
    total = F.aggregate(F.filter("cells", lambda c: c["line"].rlike(WORD)), F.lit(0).cast("long"), lambda a, c: a + F.length(c["line"]))
    left = F.filter("cells", lambda c: ~c["drop"])
    text = F.when(F.col("cells").isNull(), F.col("row")[text_col])
    if max_loss is not None:
        text = text.when(F.col("lost") > max_loss * total, F.col("row")[text_col])
    text = text.when(F.col("lost") == total, "").otherwise(F.array_join(F.transform(left, lambda c: c["line"]), "\n"))
    return judged.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
