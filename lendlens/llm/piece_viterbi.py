"""SentencePiece encoding and decoding with a streaming Viterbi search.

The best segmentation maximises the sum of the piece scores of a SentencePiece
model. Scores are kept for one window of the longest piece's length; whenever
the backpointers of all surviving paths meet in one boundary, the ids before
it are final and leave the window. Characters without a piece cost more than
any piece and are written as byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.token_files import Memory

BLANK = "▁"
UNKNOWN_COST = 10.0
CACHE = 250_000  # words of a generation that a model remembers
SHORT = 64  # characters of a word that is remembered, and held until it is complete
CHUNK = 1 << 16
GROUP = 1 << 21  # characters of texts whose new words are searched together
LOOK_BACK = 256  # a longer stretch without a common boundary is traced back


_MISSING = object()


class PieceModel:
    """The pieces, scores and byte pieces of a model file, and both directions."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.trie: dict[str, tuple[float, int] | None] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [sp.unk_id()] * 256
        whole = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                whole[piece] = (sp.get_score(i), i)
                self.bytes.append(piece.replace(BLANK, " ").encode())
        for piece in whole:
            for k in range(1, len(piece)):
                self.trie.setdefault(piece[:k], None)
        self.trie |= whole
        # the ends of pieces: a search that looks back from a character stops where no piece can reach it
        self.ends: dict[str, tuple[float, int] | None] = {piece[k:]: None for piece in whole for k in range(1, len(piece))} | whole
        self.longest = max(map(len, whole), default=1)
        self.unknown = min((s for s, _ in whole.values()), default=0.0) - UNKNOWN_COST
        self.width = "<u2" if n <= 1 << 16 else "<u4"
        self.code = "H" if n <= 1 << 16 else "I"
        self.known = Memory(CACHE)
        # no piece runs over the start of a word or over a newline: every path has boundaries there
        crossing = any("\n" in p and len(p) > 1 or BLANK in p.lstrip(BLANK) for p in whole)
        self.cut = None if crossing else re.compile(rf"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
        self.stop = re.compile(rf"(?<=[^{BLANK}]){BLANK}|\n")  # where a word ends

    # -- encoding

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int] | np.ndarray]:
        """Ids of a normalised text that arrives in chunks, each list as soon as it is final.

        Of equally good paths the one whose last piece is longer wins, piece by piece from the end.
        Where no piece runs over the start of a word, all paths meet there, so the words that a chunk
        completes are final, and short ones met before are not searched again. Held are a chunk, the short word at
        its end, and of a longer word the window of its search.
        """
        if self.cut is None:
            window = Window(self)
            for chunk in chunks:
                yield from window.push(chunk)
            yield from window.push("", True)
            return
        held, long = "", None  # the word that may go on: as it is, or in its window
        for chunk in chain(chunks, (None,)):
            if long is not None:
                stop = self.stop.search(last + (chunk or ""), 1) if chunk is not None else None
                if chunk is not None and stop is None:
                    yield from long.push(chunk)
                    last = chunk[-1:] or last
                    continue
                yield from long.push(chunk[:stop.start() - 1] if stop else "", True)
                long, chunk = None, chunk[stop.start() - 1:] if stop else None
            words = self.cut.findall(held + (chunk or ""))
            held = words.pop() if words and chunk is not None else ""
            if words:
                yield self._words(words)
            if chunk is None:
                return
            if len(held) > SHORT:
                long, last = Window(self), held[-1]
                yield from long.push(held)
                held = ""

    def _words(self, words: list[str]) -> np.ndarray:
        """The ids of whole words, each by its own search unless it is known."""
        return self._joined([words])[0]

    def _joined(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The same for the words of several texts, whose new words are searched together."""
        new = self.known.missing(set().union(*texts))
        known = self.known.now
        long = [w for w in new if len(w) > SHORT]
        for w in long:
            known[w] = np.array([i for ids in Window(self).push(w, True) for i in ids], self.width).tobytes()
        self._search(sorted(w for w in new if len(w) <= SHORT) if long else sorted(new))
        ids = [np.frombuffer(b"".join(map(known.__getitem__, words)), self.width) for words in texts]
        for w in long:
            del known[w]
        return ids

    def _search(self, words: list[str]) -> None:
        """The ids of short whole words, in order, into the memory.

        Scores and backpointers of a boundary depend on the characters before it only, so a word starts
        where it parts from the word before."""
        get, longest, unknown, known = self.ends.get, self.longest, self.unknown, self.known.now
        best, back, before = [0.0], [(0, -1)], ""
        for w in words:
            shared = 0
            for a, b in zip(w, before):  # noqa: B905 -- the shorter word ends it
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], back[shared + 1:]
            for end in range(shared + 1, len(w) + 1):
                start = end - 1
                top, link = best[start] + unknown, (start, -1)
                for start in range(start, max(end - longest, 0) - 1, -1):
                    found = get(w[start:end], _MISSING)
                    if found is None:
                        continue
                    if found is _MISSING:
                        break
                    if best[start] + found[0] >= top:  # the longer of equally good pieces
                        top, link = best[start] + found[0], (start, found[1])
                best.append(top)
                back.append(link)
            before, end, ids = w, len(w), []
            while end:
                start, piece = back[end]
                if piece < 0:
                    ids.extend(reversed(self._bytes(w[start])))
                else:
                    ids.append(piece)
                end = start
            ids.reverse()
            known[w] = array(self.code, ids).tobytes()

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one whole text; blanks become word marks and one mark goes in front."""
        if not text:
            return np.zeros(0, self.width)
        marked = BLANK + text.replace(" ", BLANK)
        return np.concatenate([np.asarray(ids, self.width) for ids in self.stream(marked[p:p + CHUNK] for p in range(0, len(marked), CHUNK))])

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """``encode`` of every text, in order. Texts of one chunk are taken in groups; longer ones go through the stream."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if self.cut is None or len(text) >= CHUNK or size + len(text) > GROUP:
                yield from self._joined(group)
                group, size = [], 0
            if self.cut is None or len(text) >= CHUNK:
                yield self.encode(text)
            else:
                group.append(self.cut.findall(BLANK + text.replace(" ", BLANK)) if text else [])
                size += len(text)
        yield from self._joined(group)

    # -- decoding

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; invalid bytes become U+FFFD, the mark in front goes."""
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


class Window:
    """A Viterbi search over text that arrives in pieces: scores and backpointers since the last final boundary."""

    def __init__(self, pieces: PieceModel):
        self.pieces = pieces
        self.text = ""
        self.best: list[float] = [0.0]  # by position after the last final boundary
        self.back: list[tuple[int, int]] = [(0, -1)]
        self.at = 0

    def push(self, chunk: str, last: bool = False) -> Iterator[list[int]]:
        """The ids that the chunk makes final; with ``last`` all that are left."""
        pieces, low = self.pieces, float("-inf")
        get, longest, unknown = pieces.trie.get, pieces.longest, pieces.unknown
        self.text += chunk
        text, best, back, at = self.text, self.best, self.back, self.at
        stop = len(text) if last else len(text) - longest  # a piece may still grow with the next chunk
        while at < stop:
            reach = len(best) - 1
            if reach == at and at or at >= LOOK_BACK and at % LOOK_BACK == 0:
                cut = at if reach == at else self._meeting(at, reach)
                if cut:
                    yield self._path(cut)
                    text = self.text = text[cut:]
                    best[:] = [x - best[cut] for x in best[cut:]]
                    back[:] = [(s - cut, p) for s, p in back[cut:]]
                    at, stop = at - cut, stop - cut
            score = best[at]
            if score > low:
                for end in range(at + 1, min(at + longest, len(text)) + 1):
                    found = get(text[at:end], _MISSING)
                    if found is None:
                        continue
                    if found is _MISSING:
                        break
                    while len(best) <= end:
                        best.append(low)
                        back.append((0, -1))
                    if score + found[0] > best[end]:
                        best[end], back[end] = score + found[0], (at, found[1])
                if not get(text[at]):
                    if len(best) == at + 1:
                        best.append(low)
                        back.append((0, -1))
                    if score + unknown > best[at + 1]:
                        best[at + 1], back[at + 1] = score + unknown, (at, -1)
            at += 1
        self.at = at
        if last and text:
            yield self._path(len(text))

    def _path(self, end: int) -> list[int]:
        ids: list[int] = []
        while end > 0:
            start, piece = self.back[end]
            if piece < 0:
                ids.extend(reversed(self.pieces._bytes(self.text[start])))
            else:
                ids.append(piece)
            end = start
        ids.reverse()
        return ids

    def _meeting(self, at: int, reach: int) -> int:
        """The last boundary that all paths which can still win have in common."""
        live = {p for p in range(at, reach + 1) if self.best[p] > float("-inf")}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.back[last][0])
        return live.pop()


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)))


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array of int) of every whole text.

    Null and empty texts have no ids. Rows are encoded one by one: repeated rows
    and null ids need no care, an empty table gives an empty result, and other
    columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(list(pieces.encode_all(b.column(1).to_pylist())))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): every row's ids back as text; null ids give a null text, no ids an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path)
        for b in batches:
            texts = [None if not v.is_valid else pieces.decode(v.values.to_numpy().tolist()) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=["id", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids, decoded): encode every whole text, then decode its ids, in one pass. Nulls as in encode_texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path)
        for b in batches:
            found = list(pieces.encode_all(b.column(1).to_pylist()))
            ids = _lists(found)
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array([pieces.decode(x.tolist()) for x in found], pa.string())],
                                             names=["id", "text", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, f"id {kind}, text string, ids array<int>, decoded string")
