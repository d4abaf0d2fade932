"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period p (words p apart are equal),
at least 2 p long, that no neighbouring word extends. Every run of a text is
found, in three ways that share the work by the size of the period:

* periods up to ``DIRECT`` by comparing words that far apart;
* longer ones scale by scale: tau = 4, 8, 16, ... serves the periods from
  3 tau - 1 to 6 tau - 2. A tau-synchronising set (Kempa and Kociumaka, 2019)
  is picked by hashes of the tau-word windows, so whether a place belongs to it
  depends on the 2 tau words that follow alone. Places with equal such
  contexts, that far apart, propose their distance as a period. The set meets
  every tau places unless the words there have a period of at most tau / 3;
* runs that hold nothing but such highly periodic regions lie across the place
  where two regions of one small period rho meet; there the periods that fit
  are congruent modulo rho, by the phases of the two regions. The regions are
  runs of smaller scales, so they are known.

A proposed period is extended to both sides by comparing hash names of
2^k words from large to small k. Every step is a numpy operation over many
texts at once; texts are kept apart by a symbol that occurs once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT = 10  # 3 tau - 2 for the smallest scale, 4
GROUP_WORDS = 1 << 18  # texts are taken together up to about so many words
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of each pair: equal pairs get equal names, others different ones but for hash collisions."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.minimum(x, NONE - np.uint64(1), out=x)


class Runs:
    """The runs of several texts; ``words`` are symbols, ``lengths`` the number of words of each text.

    Every text is followed by a symbol of its own, and the texts come longest
    first, so what a scale is too large for is cut off the end.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.w, self.lengths = words, lengths
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.names = [named(words.astype(np.uint64), np.zeros(len(words), np.uint64))]
        while 2 << (len(self.names) - 1) <= (lengths[0] if len(lengths) else 0):
            half = 1 << (len(self.names) - 1)
            left = self.names[-1][:max(0, self.upto(2 * half))]
            self.names.append(named(left[:-half], left[half:]))
        self.found = np.zeros((0, 3), np.int64)  # start, end, period
        self.phases: dict[tuple[int, int, int], int] = {}

    def upto(self, least: int) -> int:
        """Where the texts of fewer than ``least`` words begin."""
        n = int(np.searchsorted(-self.lengths, -least, "right"))
        return int(self.starts[n]) if n < len(self.starts) else len(self.w)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, a, b = self.names[k], i + n, j + n
            ok = b < len(name)
            ok[ok] = name[a[ok]] == name[b[ok]]
            n[ok] += 1 << k
        return n

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j, i before j."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, a, b = self.names[k], i - n - (1 << k), j - n - (1 << k)
            ok = (a >= 0) & (b < len(name))
            ok[ok] = name[a[ok]] == name[b[ok]]
            n[ok] += 1 << k
        return n

    def add(self, rows: np.ndarray) -> None:
        """Keep of equal stretches the one with the smallest period: the others are its multiples."""
        rows = np.concatenate((self.found, rows))
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        self.found = rows[new]

    def propose(self, i: np.ndarray, p: np.ndarray) -> None:
        """Extend the stretches through i whose words equal those p further on; keep those of 2 p words."""
        if len(i):
            start = i - self.backward(i, i + p)
            end = i + p + self.forward(i, i + p)
            ok = end - start >= 2 * p
            self.add(np.unique(np.stack((start[ok], end[ok], p[ok]), 1), axis=0))

    def direct(self) -> None:
        rows = []
        for p in range(1, DIRECT + 1):
            at = np.flatnonzero(self.w[:-p] == self.w[p:])
            if len(at):
                cut = np.flatnonzero(np.diff(at) > 1)
                first, last = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]
                ok = last - first + 1 >= p
                rows.append(np.stack((first[ok], last[ok] + 1 + p, np.full(int(ok.sum()), p)), 1))
        if rows:
            self.add(np.concatenate(rows))

    def synchronising(self, k: int, end: int) -> np.ndarray:
        """The 2^k-synchronising set of the first ``end`` symbols."""
        tau = 1 << k
        name = self.names[k][:end - tau + 1].copy()
        # windows with a period of at most tau / 3 give no name
        s, e, p = self.found.T
        small = (3 * p <= tau) & (e - s >= tau) & (s < len(name))
        edge = np.zeros(len(name) + 1, np.int64)
        np.add.at(edge, s[small], 1)
        np.add.at(edge, np.minimum(e[small] - tau + 1, len(name)), -1)
        name[np.cumsum(edge[:-1]) > 0] = NONE
        low, step = name, 1
        while step < tau:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[:-1], low[1:])
        return np.flatnonzero((low != NONE) & ((low == name[:len(low)]) | (low == name[tau:tau + len(low)])))

    def equal_contexts(self, k: int, end: int) -> None:
        tau = 1 << k
        place = self.synchronising(k, end)
        context = self.names[k + 1][place]
        order = np.argsort(context, kind="stable")
        place, context = place[order], context[order]
        i, p = [], []
        # places with one context are more than tau / 3 apart, so this ends soon
        for d in range(1, len(place)):
            far = place[d:] - place[:-d]
            same = (context[d:] == context[:-d]) & (far <= 6 * tau - 2)
            if not same.any():
                break
            same &= far >= 3 * tau - 1
            i.append(place[:-d][same])
            p.append(far[same])
        if i:
            self.propose(np.concatenate(i), np.concatenate(p))

    def meeting_regions(self, k: int) -> None:
        tau = 1 << k
        s, e, p = self.found.T
        regions = self.found[(3 * p <= tau) & (e - s >= 3 * tau - 1)]
        regions = regions[np.lexsort((regions[:, 0], regions[:, 2]))]
        i, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in np.flatnonzero((regions[1:, 2] == regions[:-1, 2]) & (regions[1:, 0] <= regions[:-1, 1])):
            (a, a_end, rho), (b, b_end, _) = regions[x].tolist(), regions[x + 1].tolist()
            if (a, b, rho) not in self.phases:
                shift = np.arange(a, a + rho)
                fits = np.flatnonzero(self.forward(shift, np.full(rho, b)) >= rho)
                self.phases[a, b, rho] = int(b - a - fits[0]) % rho if len(fits) else -1
            phase = self.phases[a, b, rho]
            if phase >= 0:
                low, high = 3 * tau - 1, min(6 * tau - 2, a_end - a + rho, b_end - b + rho)
                periods = np.arange(low + (phase - low) % rho, high + 1, rho)
                # the words of such a run equal those p further on just before the first region ends
                periods = periods[a_end - rho + periods < len(self.w)]
                i.append(np.full(len(periods), a_end - rho))
                q.append(periods)
        self.propose(np.concatenate(i), np.concatenate(q))

    def all(self) -> np.ndarray:
        """(start, end, period) of every run, places counted through all texts."""
        self.direct()
        k = 2
        while (end := self.upto(2 * ((3 << k) - 1))) > 0 and k + 1 < len(self.names):
            self.meeting_regions(k)
            self.equal_contexts(k, end)
            k += 1
        return self.found


def runs_of(texts: list[list], min_words: int = 12) -> list[np.ndarray]:
    """For every list of words its runs of ``min_words`` or more: rows (start, length, period) by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = [w for x in order for w in texts[x]]
    symbols = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False) if flat else np.zeros(0, np.int32)
    lengths = lengths[order]
    ends = np.cumsum(lengths)
    joined = np.insert(symbols.astype(np.int64), ends, np.arange(len(texts)) + len(flat))
    r = Runs(joined, lengths)
    found = r.all()
    found = found[found[:, 1] - found[:, 0] >= min_words]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    text = np.searchsorted(r.starts, found[:, 0], "right") - 1
    first, last = np.searchsorted(text, np.arange(len(texts))), np.searchsorted(text, np.arange(len(texts)), "right")
    out: list = [None] * len(texts)
    for x, a, b, at in zip(order, first, last, r.starts, strict=True):
        s, e, p = found[a:b].T
        out[x] = np.stack((s - at, e - s, p), 1)
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) <= 0)])


def periodic_runs(docs: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): a row for every row of ``docs``.

    ``runs`` holds (start, length, period) of every run of at least ``min_words``
    words, by start, then period; words are stretches without ASCII blanks.
    ``collapsed`` is the text with every run cut to its first period, words joined by one
    space. A null text, an empty one and one of blanks have no words and no runs; a null
    id stays null; equal rows give equal rows; an empty table gives an empty
    result; other columns are not read. Rows are independent, so there is no shuffle.
    Short texts are searched together; a long one takes about 8 log2(n) bytes for each of its n words.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held = 0, 0
            texts: list[list[bytes]] = []
            for i, t in enumerate(b.column(1)):
                raw = t.as_buffer()
                texts.append(raw.to_pybytes().split() if raw is not None else [])
                held += len(texts[-1])
                if held >= GROUP_WORDS or i + 1 == len(b):
                    yield result(b.column(0)[at:i + 1], texts)
                    at, held, texts = i + 1, 0, []

    def result(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, min_words)
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        ends = np.cumsum([0] + [len(x) for x in found])
        cells = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"])
        text = pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells), text],
            names=["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        search, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
