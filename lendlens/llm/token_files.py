"""Token ids in compressed binary blocks: canonical length-limited Huffman coding.

A token file set is a folder with three Parquet tables, so that Spark's own
writers commit it on any store and a retried task leaves nothing behind:

* ``code``   -- (token, bits): code lengths; canonical codes follow from them.
* ``parts``  -- (part, start): ids before each part, parts in document order.
* ``blocks`` -- one row per independent block: part, block, first (ids before
  it in its part), n_tokens, doc_ids, doc_tokens (unsigned 32-bit little-endian
  counts), steps (unsigned 16-bit bit-offset differences between checkpoints,
  one checkpoint per 256 ids) and payload (the bit stream, most significant bit
  first, in big-endian 32-bit words).

A block holds whole documents and decodes without any other block; inside it
the decoder runs all checkpoints side by side through one lookup table.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm.common import staged

STEP = 256
MAX_BITS = 18
BLOCK_TOKENS = 1 << 18

# ---------------------------------------------------------------- tokenizing

# letters and numbers of these ranges are the same in every Unicode version, are
# single code points in NFC and change case one by one
PLAIN = [chr(c) for lo, hi in ((0x20, 0x7E), (0xA1, 0x12F), (0x131, 0x17F)) for c in range(lo, hi + 1)]
WORDS_KEPT, PIECES_KEPT = 400_000, 250_000  # entries of a generation of the words and of the pre-tokens that an encoder remembers


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level pre-tokenizer writes for each byte: printable
    bytes stand for themselves, the others follow from U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


class PieceEncoder:
    """Encodes texts with a tokenizers file, remembering the ids of words and pre-tokens.

    BPE works on each pre-token alone. Where the file lower-cases, joins blanks
    and splits by a pattern, texts of plain characters are split here by the same
    pattern and only pre-tokens not seen before go to the library. Any other
    text or file goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.width = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.words, self.pieces = Memory(WORDS_KEPT), Memory(PIECES_KEPT)
        self.split = self._pattern(spec)

    @staticmethod
    def _pattern(spec: dict):
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"} \
                or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[1].get("add_prefix_space") \
                or cuts[1].get("use_regex") or not cuts[0]["invert"] or cuts[0]["behavior"] != "Removed":
            return None
        pattern = cuts[0]["pattern"].get("Regex", "")
        for kind in "LN":
            members = "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == kind)
            pattern = pattern.replace(rf"\p{{{kind}}}", members)
        plain = re.compile("[\t\n\r" + re.escape("".join(PLAIN)) + "]*")
        return None if r"\p" in pattern else (plain, re.compile(pattern))

    def encode(self, text: str) -> bytes:
        """The ids of one text, in ``width``."""
        if self.split is None or not self.split[0].fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width).tobytes()
        words = text.lower().split()
        new = self.words.missing(set(words))
        known = self.words.now
        if new:
            cuts = [self.split[1].findall(w) for w in new]
            self._learn({p for cut in cuts for p in cut})
            piece = self.pieces.now.__getitem__
            for w, cut in zip(new, cuts, strict=True):
                known[w] = piece(cut[0]) if len(cut) == 1 else b"".join(map(piece, cut))
        return b"".join(map(known.__getitem__, words))

    def _learn(self, wanted: set[str]) -> None:
        """Encode the pre-tokens not known yet, with the library's model alone."""
        tokenize, letters, code = self.library.model.tokenize, BYTE_LETTERS, "H" if self.width == "<u2" else "I"
        new = self.pieces.missing(wanted)
        pieces = self.pieces.now
        for p in new:
            ids = array(code, [t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))])
            if sys.byteorder == "big":
                ids.byteswap()
            pieces[p] = ids.tobytes()


class Memory:
    """Two generations of at most ``size`` entries each: what a full generation holds is forgotten
    unless it is asked for while the next one fills, so frequent entries stay."""

    def __init__(self, size: int):
        self.size, self.now, self.before = size, {}, {}

    def missing(self, wanted: set[str]) -> list[str]:
        """The entries that are not known; the others are in ``now`` afterwards, and there is room for the missing."""
        unknown = wanted.difference(self.now)
        if not unknown:
            return []
        if len(self.now) + len(unknown) > self.size:
            self.before, self.now = self.now, {}
            unknown = wanted
        now, before = self.now, self.before
        out = list(unknown.difference(before))
        if len(out) < len(unknown):
            now.update((w, before[w]) for w in unknown if w in before)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    return PieceEncoder(path)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, counts): the ids of every whole text and ``end_id``, as zstd-compressed unsigned integers.

    Each task adds a row without tokens whose ``counts`` say how often it wrote each id, as compressed
    64-bit integers, so that nobody needs to unpack the ids to count them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        end, total, held, size = np.array([end_id], enc.width).tobytes(), np.zeros(1, np.int64), [], 0
        kind = None

        def add(held, total):
            found = np.bincount(np.frombuffer(b"".join(held), enc.width))
            if len(found) > len(total):
                total = np.concatenate((total, np.zeros(len(found) - len(total), np.int64)))
            total[:len(found)] += found
            return total

        for b in batches:
            kind, packed = b.column(0).type, []
            for t in b.column(1):
                ids = enc.encode(t.as_py() or "") + end
                packed.append(press.compress(ids))
                held.append(ids)
                size += len(ids)
                if size > 1 << 22:
                    total, held, size = add(held, total), [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.nulls(len(b), pa.binary())], names=["id", "tokens", "counts"])
        if kind is not None:
            total = add(held, total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([press.compress(total.tobytes())], pa.binary())],
                                             names=["id", "tokens", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, tokens binary, counts binary")


# ------------------------------------------------------------------- the code

def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    kinds = np.ones(n, bool)
    for _ in range(limit):
        levels.append(kinds)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaves, pairs))
        at = np.argsort(both, kind="stable")
        row, kinds = both[at], at < n
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for kinds in reversed(levels):
        own = int(kinds[:take].sum())
        lengths[:own] += 1
        take = 2 * (min(take, len(kinds)) - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: symbols in order of (length, symbol) get consecutive codes."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order], lengths[order]
        self.bits = int(self.lengths[-1]) if len(order) else 1
        room = np.int64(1) << (self.bits - self.lengths)  # table entries of each symbol
        self.first = np.cumsum(room) - room
        self.codes = self.first >> (self.bits - self.lengths)
        self.room = room

    def encoder(self) -> np.ndarray:
        """For every symbol: its code, and its length in the five low bits."""
        out = np.zeros(int(self.symbols.max()) + 1 if len(self.symbols) else 0, np.uint32)
        out[self.symbols] = self.codes << 5 | self.lengths
        return out

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every ``bits`` wide window: the symbol and the length of its code."""
        symbols, lengths = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        used = int(self.room.sum())
        symbols[:used], lengths[:used] = np.repeat(self.symbols, self.room), np.repeat(self.lengths, self.room)
        return symbols, lengths


def pack(ids: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, steps) of one block of ids."""
    entry = codes[ids]
    size = (entry & 31).astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word, value = at >> 5, (entry >> 5).astype(np.uint64) << (64 - size - (at & 31)).view(np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    words[word[heads]] += np.add.reduceat(value >> np.uint64(32), heads)
    words[word[heads] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), heads)
    return words.astype(">u4").tobytes(), np.diff(at[::STEP]).astype("<u2").tobytes()


def unpack(payload: bytes, steps: bytes, n: int, code: Code, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of one block, decoded from all its checkpoints at once."""
    at = np.concatenate(([0], np.cumsum(np.frombuffer(steps, "<u2").astype(np.int64))))
    words = np.concatenate((np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(STEP * code.bits // 32 + 2, np.uint64)))
    windows = (words[:-1] << np.uint64(32)) | words[1:]
    symbols, lengths = table
    out = np.empty((STEP, len(at)), np.uint32)
    mask, top = np.uint64((1 << code.bits) - 1), 64 - code.bits
    for i in range(STEP):
        index = (windows[at >> 5] >> (top - (at & 31)).view(np.uint64)) & mask
        out[i] = symbols[index]
        at += lengths[index]
    return out.T.reshape(-1)[:n]


# ----------------------------------------------------------------- the files

def write_token_files(tokens: DataFrame, path: str, width: str, max_bits: int = MAX_BITS,
                      block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the rows of ``tokenize``, in ascending id order, as a token file set.

    ``tokens`` is read twice (the counts, then the ids): pass a table.
    Null ids come first; equal ids keep to one order. The code
    table reaches the driver: it has a row per token of the vocabulary.
    """
    spark = tokens.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un, total = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for b in batches:
            for t in b.column(0):
                found = np.frombuffer(un.decompress(t.as_py()), np.int64)
                if len(found) > len(total):
                    total = np.concatenate((total, np.zeros(len(found) - len(total), np.int64)))
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])

    counts = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")) \
        .orderBy("token").collect()
    tokens = tokens.filter("tokens IS NOT NULL").select("id", "tokens")
    symbols = np.array([r["token"] for r in counts], np.int64)
    lengths = code_lengths(np.array([r["n"] for r in counts], np.int64), max_bits)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un, part = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        codes = Code(symbols, lengths).encoder()
        docs, held, n_held, first, block = [], [], 0, 0, 0

        def flush():
            ids = np.concatenate(held)
            payload, steps = pack(ids, codes)
            counts = np.array([len(x) for x in held], "<u4").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([docs], pa.list_(id_type)), pa.array([counts], pa.binary()), pa.array([steps], pa.binary()), pa.array([payload], pa.binary())],
                names=["part", "block", "first", "n_tokens", "doc_ids", "doc_tokens", "steps", "payload"])

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for i, t in zip(b.column(0), b.column(1), strict=True):
                ids = np.frombuffer(un.decompress(t.as_py()), width)
                docs.append(i.as_py())
                held.append(ids)
                n_held += len(ids)
                if n_held >= block_tokens:
                    yield flush()
                    docs, held, n_held, first, block = [], [], 0, first + n_held, block + 1
        if held:
            yield flush()

    kind = tokens.schema["id"].dataType.simpleString()
    ordered = tokens.repartitionByRange("id", F.xxhash64("tokens")).sortWithinPartitions("id", "tokens")
    ordered.mapInArrow(blocks, f"part int, block int, first long, n_tokens long, doc_ids array<{kind}>, "
                               "doc_tokens binary, steps binary, payload binary") \
        .write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(s), int(n)) for s, n in zip(symbols, lengths, strict=True)], "token long, bits int") \
        .coalesce(1).write.parquet(f"{path}/code")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts = np.concatenate(([0], np.cumsum([r["n"] for r in sizes], dtype=np.int64)))
    spark.createDataFrame([(r["part"], int(s)) for r, s in zip(sizes, starts, strict=False)], "part int, start long") \
        .coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of a token file set; ids are little-endian unsigned 32-bit integers."""
    table = spark.read.parquet(f"{path}/blocks")
    code_rows = spark.read.parquet(f"{path}/code").collect()
    starts = {r["part"]: r["start"] for r in spark.read.parquet(f"{path}/parts").collect()}
    symbols, lengths = (np.array([r[c] for r in code_rows], np.int64) for c in ("token", "bits"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(symbols, lengths)
        lookup = code.table()
        for b in batches:
            for part, first, n, docs, counts, steps, payload in zip(*b.columns, strict=True):
                ids = unpack(payload.as_py(), steps.as_py(), n.as_py(), code, lookup).astype("<u4")
                size = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
                ends = np.cumsum(size)
                whole = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(ends - size + starts[part.as_py()] + first.as_py()), pa.array(size),
                     pa.array([bytes(whole[4 * (e - s):4 * e]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=["id", "start", "n_tokens", "ids"])

    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    return table.select("part", "first", "n_tokens", "doc_ids", "doc_tokens", "steps", "payload") \
        .mapInArrow(decode, f"id {kind}, start long, n_tokens long, ids binary")


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Tokenize whole texts once and write them as a token file set.

    A null text counts as empty: its only id is the end id. Null ids come first,
    rows with equal ids stay separate, an empty table gives an empty file set, and
    other columns are not read. Texts of any length are handled one at a time.
    """
    tokens = staged(tokenize(docs, tokenizer, end_id, id_col, text_col), "tokens", "none")
    width = encoder(tokenizer).width
    if end_id >= 1 << (8 * int(width[-1])):
        raise ValueError("the end id does not fit the ids' width")
    write_token_files(tokens, path, width)
