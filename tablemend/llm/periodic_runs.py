"""Periodic runs: stretches of words that repeat with a period, found by online dyadic square catching.

A square is two equal stretches of q words side by side.  For periods from 2B up to 4B (B a power
of two) its first half holds a whole block of B words that starts at a multiple of B.  Each such block,
once complete, is a catcher: it waits for its own words to come again 2B to 4B words later.  A word
that is appended ends a new suffix of B words at every level; of the blocks only two can be in reach of that
suffix, so each word advances two comparisons per level, by a 64-bit code of B words that is made of
two codes of half as many.  What one catcher and the next find at the same distance are pieces of one
stretch: they chain up, and once a chain can neither grow nor be too short for a run, its two ends are
compared word by word (fewer than B words each way) and the whole of it is checked on the words
themselves.  Squares of one period that overlap thus merge into one run.

Words come in slabs.  State between slabs is the words, the codes within reach and the open chains, so a
document may be fed a word at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablemend.llm.words import joined, pieces, split_words, text_column

EXPONENT = 4
LEAST = 6
SLAB = 1 << 15  # words appended at once
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S, _T = np.uint64(32), np.uint64(29)
_NONE = np.zeros((3, 0), np.int64)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _coded(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A code for each pair of codes; no sum of powers, which periodic words can defeat."""
    x = left * _A + (right ^ (right >> _S)) * _B
    x ^= x >> _T
    x *= _C
    return x ^ (x >> _S)


class _Level:
    """The catchers of blocks of ``size`` words and distances from size * reach[0] on."""

    def __init__(self, size: int, reach: tuple[int, ...]):
        self.size, self.reach = size, reach
        self.codes, self.offset = np.zeros(0, np.uint64), 0  # code of the words from each place on
        self.at = 0  # places before it have been compared
        self.chains = _NONE  # open ones: distance, first block, last block

    def hits(self, upto: int) -> np.ndarray:
        """(distance, block) for every place before ``upto`` whose words a catcher in reach waits for."""
        found = []
        for k in self.reach:
            p = np.arange(max(self.at, k * self.size), upto)
            s = (p // self.size - k) * self.size
            same = np.flatnonzero(self.codes[p - self.offset] == self.codes[s - self.offset])
            if len(same):
                found.append(np.stack([p[same] - s[same], s[same]]))
        self.at = max(self.at, upto)
        return np.concatenate(found, axis=1) if found else _NONE[:2]

    def grow(self, hits: np.ndarray, n: int | None) -> np.ndarray:
        """Adds hits to the chains; returns those that nothing can be added to once ``n`` words are there
        (None: the text has ended)."""
        every = np.concatenate([self.chains, hits[[0, 1, 1]]], axis=1)
        if not every.shape[1]:
            return _NONE
        q, first, last = every[:, np.lexsort((every[1], every[0]))]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (first[1:] != last[:-1] + self.size)
        heads = np.flatnonzero(new)
        q, first, last = q[heads], first[heads], last[np.append(heads[1:], len(q)) - 1]
        closed = np.ones(len(q), bool) if n is None else last + q + 2 * self.size <= n
        self.chains = np.stack([q[~closed], first[~closed], last[~closed]])
        return np.stack([q[closed], first[closed], last[closed]])


class Catchers:
    """The runs of one text whose words come in slabs of ids.

    A run has a length of at least ``least`` words and of ``exponent`` times its period; the exponent is 2 or
    more.
    """

    def __init__(self, exponent: float = EXPONENT, least: int = LEAST):
        if exponent < 2:
            raise ValueError("a run holds a square: exponent must be 2 or more")
        self.exponent, self.least = exponent, least
        self._held = np.zeros(0, np.int64)
        self.n = 0
        self.levels: list[_Level] = []
        self.found: dict[tuple[int, int], int] = {}  # (start, end) -> period

    @property
    def words(self) -> np.ndarray:
        return self._held[: self.n]

    def append(self, slab: np.ndarray) -> None:
        """Takes the next words."""
        if not self.n:
            self._held = np.asarray(slab, np.int64)
        else:
            if self.n + len(slab) > len(self._held):
                self._held = np.concatenate([self.words, np.zeros(self.n + len(slab), np.int64)])
            self._held[self.n : self.n + len(slab)] = slab
        self.n += len(slab)
        below: _Level | None = None
        for i in range(64):
            size, reach = 1 << max(i - 1, 0), (2, 3) if i else (1,)
            if self.n < self.exponent * size * reach[0]:
                break
            if i == len(self.levels):
                self.levels.append(_Level(size, reach))
            level = self.levels[i]
            self._code(level, below)
            self._take(level, level.grow(level.hits(self.n - size + 1), self.n))
            below = level
        for level in self.levels:  # what no comparison can reach any more
            old = max(0, level.at - 4 * level.size) - level.offset
            if old > SLAB:
                level.codes, level.offset = level.codes[old:].copy(), level.offset + old

    def end(self) -> np.ndarray:
        """No more words come: (start, length, period) of every run, by start, then period."""
        for level in self.levels:
            self._take(level, level.grow(_NONE[:2], None))
        rows = [(s, e - s, q) for (s, e), q in self.found.items()]
        return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)

    def _code(self, level: _Level, below: _Level | None) -> None:
        have, half = level.offset + len(level.codes), level.size // 2
        if level.size == 1:
            w = self.words[have:].astype(np.uint64)
            new = _coded(w, w)
        elif below is not None and below.offset <= have:
            c = below.codes[have - below.offset :]
            new = _coded(c[: len(c) - half], c[half:])
        else:  # a level that opens late in a long text
            w = self.words.astype(np.uint64)
            new, size = _coded(w, w), 1
            while size < level.size:
                new, size = _coded(new[: len(new) - size], new[size:]), 2 * size
            level.codes, level.offset = new[:0], 0
        level.codes = np.concatenate([level.codes, new]) if len(level.codes) else new

    def _take(self, level: _Level, chains: np.ndarray) -> None:
        q, first, last = chains
        same = last - first + level.size  # words equal to those q further on; at each end fewer than a block may be added
        most = same + 2 * (level.size - 1)
        q, first, last = chains[:, (most >= (self.exponent - 1) * q) & (most + q >= self.least)]
        if len(q) > 1:  # a multiple of a known run's period within that run is that run
            left = np.ones(len(q), bool)
            for (s, e), p in self.found.items():
                left &= (q % p != 0) | (first < s) | (last + level.size + q > e)
            q, first, last = q[left], first[left], last[left]
        for lag, a, b in zip(q.tolist(), first.tolist(), (last + level.size).tolist(), strict=True):
            self._settle(lag, a, b, level.size - 1)

    def _settle(self, q: int, a: int, b: int, most: int) -> None:
        """The whole stretch of words equal to those ``q`` further on around [a, b), fewer than a block away."""
        if any(s <= a and b + q <= e and q % p == 0 for (s, e), p in self.found.items()):
            return
        w, low, high = self.words, max(0, a - most), min(b + most, self.n - q)
        differs = np.flatnonzero(w[low:a] != w[low + q : a + q])
        a = low + int(differs[-1]) + 1 if len(differs) else low
        differs = np.flatnonzero(w[b:high] != w[b + q : high + q])
        b = b + int(differs[0]) if len(differs) else max(b, high)
        if np.array_equal(w[a:b], w[a + q : b + q]):
            stretches = [(a, b)]
        else:  # two codes met by chance: look at all words at this distance
            turns = np.diff(np.concatenate([[0], (w[: self.n - q] == w[q:]).astype(np.int8), [0]]))
            stretches = list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True))
        for a, b in stretches:
            if b - a + q >= max(self.least, self.exponent * q):
                self.found[a, b + q] = min(q, self.found.get((a, b + q), q))


def runs_of(words: np.ndarray, exponent: float = EXPONENT, least: int = LEAST, slab: int = SLAB) -> np.ndarray:
    """(start, length, period) of every run of a text given as word ids."""
    catchers = Catchers(exponent, least)
    for s in range(0, len(words), slab):
        catchers.append(words[s : s + slab])
    return catchers.end()


def find_runs(docs: DataFrame, exponent: float = EXPONENT, least: int = LEAST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, ``runs`` (start, length, period; by start, then
    period), and ``collapsed``: the text without the words that a run only repeats.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; a run is a stretch with smallest period q, at least
    ``least`` words and ``exponent`` * q words long, that neither neighbour extends.  A word is left out of
    ``collapsed`` if a run contains it behind its first q words; the others are joined by one space.  A missing or
    empty text has no words and an empty ``collapsed``.  Repeated rows and rows without doc_id give a row each; other
    columns of ``docs`` are not looked at.  A text is worked on in one task, in memory in proportion to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in pieces(b)):
            words, counts = split_words(text_column(piece["text"]))
            ids = np.asarray(words.dictionary_encode().indices, np.int64)
            kept, ends, every = np.ones(len(ids), bool), np.cumsum(counts), []
            for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
                own = runs_of(ids[end - n : end], exponent, least)
                every.append(own)
                for start, length, period in own.tolist():
                    kept[end - n + start + period : end - n + start + length] = False
            flat = np.concatenate(every).T if every else np.zeros((3, 0), np.int64)
            at = np.append(0, np.cumsum([len(r) for r in every])).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat], fields=list(RUN))
            yield pa.record_batch(
                [piece["doc_id"], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(at), structs), joined(words, counts, kept)], ["doc_id", "n_words", "runs", "collapsed"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
