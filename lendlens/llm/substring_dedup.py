"""Substring dedup: windows of words that occur more than once, through sharded FM-indexes.

A window is ``window`` consecutive words of one row. Every word covered by a
window whose words also start anywhere else goes.

* Windows are dealt to shards by content: the smallest hash among a window's
  ``GRAM``-word grams. Consecutive windows with one such hash travel as one
  segment, so every window lies in exactly one segment, equal windows meet in
  one shard, and no document is searched in more than the shards of its own
  segments. A segment whose gram occurs nowhere else holds no repeated
  window and stays behind; only hashes are shuffled to find that out.
* Equal segments are merged and counted. Each shard builds a compressed
  FM-index of its segments: the Burrows-Wheeler transform in a wavelet matrix of
  packed bits with a count per 64 of them. The segments are then streamed
  through it from their last word to the first by backward search, all of a
  shard side by side. The search keeps matching statistics: the longest match
  with two occurrences that starts here. Where a word cannot be prepended, the
  match is cut at its end to the parent interval, from the capped longest
  common prefixes of neighbouring rows.
* A hash with too many different segments (they share the words around it
  and differ elsewhere) would make one shard too large: its segments are cut
  into single windows, dealt by their own hash.

Shards hold a bounded number of words, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import BROADCAST_KEYS, joined, small_batches, staged

GRAM = 16
GROUP_WORDS = 1 << 18  # texts are cut into segments together up to about so many words
LONGEST = 64  # windows of a segment
SHARD_BYTES = 2 << 20  # words of a shard, on average
CROWD = 4096  # different segments of a key from which on they are cut into windows


# ------------------------------------------------------------------ segments

def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:len(values) - (width - step)], values[width - step:])


def cut(texts: list[list[bytes]], window: int, gram: int = GRAM) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every list of words its segments: (first window, number of windows, key, how often the key's gram occurs in it)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    out = [(none, none, none, none)] * len(texts)
    flat = [w for t, n in zip(texts, lengths, strict=True) if n >= window for w in t]
    if not flat:
        return out
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    level, step = names, 1
    while step < gram:  # gram is a power of two
        level = _named(level[:-step], level[step:])
        step *= 2
    level = level.view(np.int64)
    low, more = _lowest(level, window - gram + 1), window - gram
    at = 0
    for x, n in enumerate(lengths.tolist()):
        if n >= window:
            own = low[at:at + n - window + 1]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            size = np.diff(first, append=len(own))
            if size.max() > LONGEST:
                parts = -(-size // LONGEST)
                offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                first = np.repeat(first, parts) + LONGEST * offset
                size = np.diff(first, append=len(own))
            reach = size + more
            ends = np.cumsum(reach)
            grams = np.arange(ends[-1]) + np.repeat(at + first - (ends - reach), reach)
            same = level[grams] == np.repeat(own[first], reach)
            out[x] = (first, size, own[first], np.add.reduceat(same, ends - reach, dtype=np.int64))
            at += n
    return out


def _batches(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Rows (from, to) of a batch with the words of their texts, in groups of bounded size."""
    at, held = 0, 0
    texts: list[list[bytes]] = []
    for i, t in enumerate(b.column(column)):
        raw = t.as_buffer()
        texts.append(raw.to_pybytes().split() if raw is not None else [])
        held += len(texts[-1])
        if held >= GROUP_WORDS or i + 1 == len(b):
            yield at, i + 1, texts
            at, held, texts = i + 1, 0, []


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): equal rows share their identity, and so their decisions."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def segments(rows: DataFrame, window: int, gram: int = GRAM) -> DataFrame:
    """(id, th, at, n, key, grams) of every segment of (id, th, text) rows."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in _batches(b, 2):
                found = cut(texts, window, gram)
                size = np.array([len(f[0]) for f in found])
                row = pa.array(np.repeat(np.arange(lo, hi), size))
                cells = [pa.array(np.concatenate([f[c] for f in found])) for c in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), cells[0].cast(pa.int32()), cells[1].cast(pa.int32()), cells[2], cells[3]],
                                                 names=["id", "th", "at", "n", "key", "grams"])

    return rows.mapInArrow(run, f"id {kind}, th long, at int, n int, key long, grams long")


# ------------------------------------------------------------------- the index

class WaveletMatrix:
    """Ranks of symbols in a sequence, on packed bits."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 - len(bit) % 64, np.uint8))), bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.before.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            order = bit.astype(bool)
            symbols = np.concatenate((symbols[~order], symbols[order]))

    def move(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the first ``place`` entries' copies of ``symbol`` end in the matrix's last order."""
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            word = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)
            place = np.where(symbol >> b & 1, self.zeros[level] + ones, place - ones)
        return place


class FMIndex:
    """An index of texts (lists of symbols from 1 on, each followed by 0), for matches of up to ``depth`` symbols
    with two occurrences; ``weights`` says how often each text counts."""

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, depth: int):
        self.symbols, self.depth, n = symbols, depth, len(symbols)
        top = int(symbols.max())
        # ranks of all stretches of 1, 2, 4, ... symbols; then rows sorted by their first depth + 1 symbols at least
        ranks, step = [np.concatenate((symbols + 1, np.zeros(depth + 2, np.int64)))], 1
        while 2 * step <= depth + 1:
            r = ranks[-1]
            ranks.append(self._next(r, step))
            step *= 2
        whole = self._next(ranks[-1], depth + 1 - step) if step < depth + 1 else ranks[-1]
        sa = np.argsort(whole[:n], kind="stable")
        lcp = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            same = ranks[k][np.minimum(sa[1:] + lcp, n)] == ranks[k][np.minimum(sa[:-1] + lcp, n)]
            lcp[same] += 1 << k
        lcp = np.concatenate(([-1], np.minimum(lcp, depth), [-1])).astype(np.int8)
        self.before = np.concatenate(([0], np.cumsum(weights[sa])))
        self.wavelet = WaveletMatrix(symbols[sa - 1], top)
        counts = np.cumsum(np.bincount(symbols, minlength=top + 1))
        every = np.arange(top + 1)
        self.shift = np.concatenate(([0], counts[:-1])) - self.wavelet.move(every, np.zeros(top + 1, np.int64))
        # smallest common prefix of 2^k neighbours, for the parent of an interval
        self.lows = [lcp]
        while 2 << (len(self.lows) - 1) <= len(lcp):
            half = 1 << (len(self.lows) - 1)
            self.lows.append(np.minimum(self.lows[-1][:-half], self.lows[-1][half:]))
        edge = np.flatnonzero(lcp < depth - 1)
        row = np.searchsorted(edge, np.arange(n), "right")
        self.first, self.last = edge[row - 1].astype(np.int32), edge[row].astype(np.int32)
        self.n = n

    @staticmethod
    def _next(rank: np.ndarray, step: int) -> np.ndarray:
        n = len(rank) - step
        key = rank[:n] * (int(rank.max()) + 1) + rank[step:]
        return np.concatenate((np.unique(key, return_inverse=True)[1] + 1, np.zeros(step, np.int64)))

    def prepend(self, symbol: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.move(np.concatenate((symbol, symbol)), np.concatenate((left, right))) + np.concatenate((self.shift[symbol],) * 2)
        return both[:len(left)], both[len(left):]

    def parent(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger interval, and the length of its match."""
        lcp = self.lows[0]
        depth = np.maximum(lcp[left], lcp[right])
        left, right = left.copy(), right.copy()
        for k in range(len(self.lows) - 1, -1, -1):
            low, step = self.lows[k], 1 << k
            at = left - step + 1
            ok = at >= 0
            ok[ok] = low[at[ok]] >= depth[ok]
            left[ok] -= step
            ok = right < len(low)
            ok[ok] = low[right[ok]] >= depth[ok]
            right[ok] += step
        top = depth <= 0
        left[top], right[top] = 0, self.n
        return left, right, np.maximum(depth, 0).astype(np.int64)

    def repeated(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which places of the indexed texts (start, length) begin a stretch of ``depth`` symbols that occurs twice."""
        hit = np.zeros(self.n, bool)
        place = start + length - 1
        left, right, size = np.zeros(len(start), np.int64), np.full(len(start), self.n), np.zeros(len(start), np.int64)
        while len(place):
            new_left, new_right = self.prepend(self.symbols[place], left, right)
            ok = self.before[new_right] - self.before[new_left] >= 2
            left, right, size = np.where(ok, new_left, left), np.where(ok, new_right, right), size + ok
            full = np.flatnonzero(size == self.depth)
            if len(full):
                hit[place[full]] = True
                row = left[full]
                left[full], right[full], size[full] = self.first[row], self.last[row], self.depth - 1
            lost = ~ok
            place = place - (ok | (size == 0))
            short = np.flatnonzero(lost & (size > 0))
            if len(short):
                left[short], right[short], size[short] = self.parent(left[short], right[short])
            on = np.flatnonzero(size + (place - start + 1) >= self.depth)
            place, start, left, right, size = place[on], start[on], left[on], right[on], size[on]
        return hit


def search(texts: list[list[bytes]], weights: np.ndarray, window: int) -> list[np.ndarray]:
    """For every text its windows (first words) that occur twice in all texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    symbols = np.insert(coded.astype(np.int64) + 1, ends, 0)
    start = ends - lengths + np.arange(len(texts))
    hit = FMIndex(symbols, np.repeat(weights, lengths + 1), window).repeated(start, lengths)
    return [np.flatnonzero(hit[s:s + n]) for s, n in zip(start.tolist(), lengths.tolist(), strict=True)]


# ------------------------------------------------------------------- the corpus

def _spans(places: np.ndarray, window: int) -> list[dict[str, int]]:
    """Word spans covered by windows at ``places``, ascending."""
    if not len(places):
        return []
    gap = np.flatnonzero(np.diff(places) > window)
    first, last = places[np.concatenate(([0], gap + 1))], places[np.concatenate((gap, [len(places) - 1]))]
    return [{"first": int(a), "last": int(b) + window} for a, b in zip(first, last, strict=True)]


SPANS = "array<struct<first: int, last: int>>"


def _emit(rows: DataFrame, window: int) -> DataFrame:
    """(id, th, at, key, h1, h2, words): the wanted segments of (id, th, text, wanted) rows, with 128 bits that stand for each."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in _batches(b, 2):
                wanted = b.column(3)[lo:hi]
                row = np.repeat(np.arange(lo, hi), np.diff(wanted.offsets.to_numpy()))
                at, n, key = [wanted.flatten().field(c) for c in range(3)]
                seg = [b" ".join(texts[r][a:a + m + window - 1]) for r, a, m in zip((row - lo).tolist(), at.to_pylist(), n.to_pylist(), strict=True)]
                take = pa.array(row)
                both = np.array([divmod(xxhash.xxh3_128_intdigest(s), 1 << 64) for s in seg], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), at, key, pa.array(both[:, 0]),
                     pa.array(both[:, 1]), pa.array(seg, pa.binary())], names=["id", "th", "at", "key", "h1", "h2", "words"])

    return rows.mapInArrow(run, f"id {kind}, th long, at int, key long, h1 long, h2 long, words binary")


def _windows(crowded: DataFrame, window: int) -> DataFrame:
    """(s1, s2, offset, h1, h2, words, rows): the single windows of segments, with their own 128 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s1, s2, offset, seg, n = [], [], [], [], []
            for a, c, text, rows in zip(*b.columns, strict=True):
                words = text.as_py().split()
                for i in range(len(words) - window + 1):
                    s1.append(a.as_py())
                    s2.append(c.as_py())
                    offset.append(i)
                    seg.append(b" ".join(words[i:i + window]))
                    n.append(rows.as_py())
            both = np.array([divmod(xxhash.xxh3_128_intdigest(s), 1 << 64) for s in seg], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(offset, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                 pa.array(seg, pa.binary()), pa.array(n, pa.int64())], names=["s1", "s2", "offset", "h1", "h2", "words", "rows"])

    return crowded.select("h1", "h2", "words", "rows").mapInArrow(run, "s1 long, s2 long, offset int, h1 long, h2 long, words binary, rows long")


def _search_shards(units: DataFrame, window: int) -> DataFrame:
    """(h1, h2, spans) of every unit (shard, h1, h2, words, rows) with a repeated window."""
    def run(table: pa.Table) -> pa.Table:
        texts = [t.as_buffer().to_pybytes().split() for t in table.column("words")]
        found = search(texts, table.column("rows").to_numpy(), window)
        some = [i for i, f in enumerate(found) if len(f)]
        spans = pa.array([_spans(found[i], window) for i in some], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
        return pa.table({"h1": table.column("h1").take(pa.array(some, pa.int64())), "h2": table.column("h2").take(pa.array(some, pa.int64())), "spans": spans})

    return units.groupBy("shard").applyInArrow(run, f"h1 long, h2 long, spans {SPANS}")


def repeated_spans(rows: DataFrame, window: int, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, crowd: int = CROWD) -> DataFrame:
    """(id, th, spans): word spans of (id, th, text) rows that repeated windows cover; rows without one do not appear."""
    light = staged(segments(rows, window, gram), "segments")
    n_light = light.count()
    # a gram that occurs once in the corpus is in no repeated window
    keys = staged(light.groupBy("key").agg(F.sum("grams").alias("rows")).filter("rows > 1"), "repeated-keys")
    # of equal rows, each gets the wanted segments again by the join with its text
    wanted = joined(light.select("id", "th", "at", "n", "key"), keys, ["key"], n_light, crowd).groupBy("id", "th").agg(F.collect_set(F.struct("at", "n", "key")).alias("wanted")) \
        .withColumnsRenamed({"id": "_id", "th": "_th"})
    texts = rows.join(wanted, rows["id"].eqNullSafe(F.col("_id")) & (rows["th"] == F.col("_th")))
    with small_batches(rows.sparkSession):
        places = staged(_emit(texts.select("id", "th", "text", "wanted"), window), "candidate-segments")
    distinct = staged(places.groupBy("h1", "h2", "key", "words").agg(F.count("*").alias("rows")), "distinct-segments")
    n_distinct, n_bytes = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()
    if not n_distinct:
        return rows.select("id", "th", F.array().cast(SPANS).alias("spans")).limit(0)
    crowd = max(crowd, n_distinct // BROADCAST_KEYS)
    crowded = F.broadcast(distinct.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > crowd).select("key"))
    single = staged(_windows(distinct.join(crowded, "key", "left_semi"), window), "single-windows")
    units = distinct.join(crowded, "key", "left_anti").select("key", "h1", "h2", "words", "rows").unionByName(
        single.groupBy("h1", "h2", "words").agg(F.sum("rows").alias("rows")).withColumn("key", F.col("h1")))
    shards = max(1, n_bytes // shard_bytes)
    found = staged(_search_shards(units.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), window), "repeated-units")
    # single windows tell about the segments that they were cut from
    cells = single.select("s1", "s2", "offset", "h1", "h2").join(found.select("h1", "h2"), ["h1", "h2"], "left_semi") \
        .groupBy(F.col("s1").alias("h1"), F.col("s2").alias("h2")) \
        .agg(F.collect_set(F.struct(F.col("offset").alias("first"), (F.col("offset") + window).alias("last"))).alias("spans"))
    whole = found.join(distinct.join(crowded, "key", "left_anti").select("h1", "h2", "rows"), ["h1", "h2"]) \
        .unionByName(cells.join(distinct.select("h1", "h2", "rows"), ["h1", "h2"]))
    hits = joined(places.select("id", "th", "at", "h1", "h2"), staged(whole, "repeated-segments"), ["h1", "h2"], places.count(), crowd)
    moved = F.transform("spans", lambda s: F.struct((F.col("at") + s["first"]).alias("first"), (F.col("at") + s["last"]).alias("last")))
    return hits.select("id", "th", moved.alias("s")).groupBy("id", "th").agg(F.flatten(F.collect_set("s")).alias("spans"))


def drop_repeated(docs: DataFrame, window: int = 35, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, crowd: int = CROWD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): a row for every row of ``docs``, its text without the repeated words.

    A word goes if a window of ``window`` words that holds it also starts at another place of any
    row; windows are judged on the input. Words are stretches without ASCII blanks; ``kept`` joins those that
    stay by one space. A null text, an empty one and one of blanks have no words. Rows with equal ids
    are told apart by their texts, equal rows repeat each other, null ids stay null, an empty
    table gives an empty result, and other columns are not read. Texts may have any length.
    """
    if gram & (gram - 1) or gram > window:
        raise ValueError("gram must be a power of two, and no longer than the window")
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, window, gram, shard_bytes, crowd).withColumnsRenamed({"id": "_id", "th": "_th"})
    kind = rows.schema["id"].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in _batches(b, 1):
                removed, kept = [], []
                for words, found in zip(texts, b.column(2)[lo:hi], strict=True):
                    gone = 0
                    if found.is_valid and len(found):
                        cells = found.values
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, cells.field("first").to_numpy(), 1)
                        np.add.at(edge, cells.field("last").to_numpy(), -1)
                        stay = np.flatnonzero(np.cumsum(edge[:-1]) <= 0)
                        gone, words = len(words) - len(stay), [words[i] for i in stay]
                    removed.append(gone)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return rows.join(spans, rows["id"].eqNullSafe(F.col("_id")) & (rows["th"] == F.col("_th")), "left").select("id", "text", "spans") \
        .mapInArrow(clean, f"id {kind}, n_words long, n_removed long, kept string")
