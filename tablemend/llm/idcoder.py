"""An adaptive context-mixing range coder for token ids.

A chunk of ids is cut into blocks.  Every block starts with an empty model and has its own code words
and checksum, so it can be read alone.  The ids of a block lie in lanes of equal length, which share the
model and are coded side by side, one id of each per step, as array operations over lanes.

The id that followed the last two ids most often (order 2) and the last one (order 1) are predicted.
How likely either is right comes from two adaptive models, one of how often such predictions came true
in their contexts, one of which predictions came true last in the lane; they are mixed by a weight that
follows the better of them, then with what was seen of both together.  If neither is right, order 0 takes
over: the adaptive frequencies of the ids that were not predicted; an id not met in the block is written
out.  The model learns after each round of steps, at first one, later up to 32, from all ids of the round.
Range coders with 64-bit state turn the intervals into 32-bit words.  All of it is integer arithmetic, so
any machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

CHUNK_TOKENS = 2 << 20
BLOCK_TOKENS = 1 << 20  # about; blocks of a chunk are of one size
_LANES = 4096  # above which lanes have their most ids
_LENGTH = (256, 512)  # least and most ids of a lane
_ROUND = 32  # most steps between two updates
_ROWS = 4  # steps whose intervals are looked up at once, to stay in the processor's cache
_MAGIC = b"IDC2"
_HEAD = struct.Struct("<IIIIII")  # ids, ids of a lane, ids below which all are, listed ids, code words, checksum
_DENSE = 1 << 20  # larger ids are coded by their place in a list
_EVEN = 16  # bits of the scale on which the predictions' chances are
_LEAST, _RARE = 8, 256  # least chances: of a prediction's being right, of none's
_PASTS = 16
_LEVELS = 16
_PAIRS = _LEVELS * _LEVELS * 2
_FULL = np.uint64(1 << 32)
_LOW = np.uint64(0xFFFFFFFF)
_WORD = np.uint64(32)


def _levels() -> np.ndarray:
    """What a context's counts (times of its best id, then of all; 6 bits each) say about the best id, in 16 levels."""
    best, total = np.divmod(np.arange(1 << 12), 64)
    share = 8 * best // np.maximum(total, 1)
    few = np.where(total == 1, 1, np.where(total == 2, np.clip(best + 1, 2, 3), 3 + np.clip(share // 2, 1, 4)))
    return np.where(total == 0, 0, np.where(total < 7, few, 8 + np.minimum(share, 7)))


_LEVEL = _levels()


class _Model:
    """Predictions and frequencies of a block of ``n`` ids below ``top``."""

    def __init__(self, n: int, top: int):
        bits = min(max(n.bit_length(), 10), 20)
        self.shift = [np.uint64(64 - min(bits, 17)), np.uint64(64 - bits)]
        self.best = [np.zeros(1 << (64 - int(s)), np.int64) for s in self.shift]  # id + 1; times of it and times in all, 6 bits each; level, 4 bits
        self.weight = 8
        self.came = np.zeros((3, _PAIRS, _PASTS), np.int64)  # order 2 right, else order 1, else none
        self.by_sure, self.by_past = self._chances(2), self._chances(1)
        self.scale = bits
        self.top = top
        self.times = np.zeros(top, np.int64)
        self.waiting: list[np.ndarray] = []
        self.mix(np.zeros_like(self.came))
        self.rank()

    def contexts(self, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        """Where the followers of the last id, and of the last two, are kept; ids are 1 more than they are, 0 stands before the first."""
        first = one.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        second = first + two.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return [(h >> s).view(np.int64) for h, s in zip((first, second), self.shift, strict=True)]

    def predict(self, at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids that orders 1 and 2 predict (-1: none), and how sure both are."""
        one, two = (table.take(a) for table, a in zip(self.best, at, strict=True))
        id1, id2 = (one >> 16) - 1, (two >> 16) - 1
        return id1, id2, ((two & 15) << 5) | ((one & 15) << 1) | (id1 == id2)

    def mix(self, new: np.ndarray) -> None:
        """Adds what came true and sets the chances, of 2^16 as running sums, of every pair of levels and past."""
        new = new.reshape(3, _PAIRS, _PASTS)
        ahead = int((np.sign(self.by_sure[:, :, None] - self.by_past[:, None]) * new).sum())
        self.weight = min(max(self.weight + (ahead > 0) - (ahead < 0), 1), 15)
        self.came += new
        self.by_sure, self.by_past = self._chances(2), self._chances(1)
        mixed = self.by_sure[:2, :, None] * self.weight + self.by_past[:2, None] * (16 - self.weight)
        two, one = ((self.came[:2] << _EVEN) + mixed) // (self.came.sum(0) + 16)
        two = np.minimum(np.maximum(two, _LEAST), (1 << _EVEN) - 2 * _RARE)
        two[:32] = 0  # nothing is predicted by order 2
        one = np.minimum(np.maximum(one, _LEAST), (1 << _EVEN) - _RARE - two)
        one[1::2] = 0  # or by order 1, or the same
        one.reshape(_LEVELS, _LEVELS, 2, _PASTS)[:, 0] = 0
        self.upto = np.stack([np.zeros_like(two), two, two + one, np.full_like(two, 1 << _EVEN)]).reshape(4, -1).view(np.uint64)
        self.wide = np.diff(self.upto, axis=0).reshape(-1)

    def _chances(self, axis: int) -> np.ndarray:
        came = self.came.sum(axis)
        return ((came << _EVEN) + np.array([[24_000], [12_000], [29_536]])) // (came.sum(0) + 1)

    def rank(self) -> None:
        """Adds the ids that were not predicted to the frequencies and lays out their intervals, that of ids never met last."""
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int64)
        new = np.bincount(ids, minlength=self.top)
        fresh = int(new[self.times == 0].sum())
        self.times += new
        self.waiting = []
        whole = 1 << self.scale
        times = self.times
        while np.count_nonzero(times) > whole >> 2:
            times = times >> 1
        rest = whole - min(max(whole * fresh // max(len(ids), 1), whole >> 10), whole >> 1) - np.count_nonzero(times)
        width = np.where(times > 0, 1 + times * rest // max(int(times.sum()), 1), 0)
        self.ends = np.append(np.cumsum(width), whole)
        self.start = np.concatenate([[0], self.ends[:-1]]).astype(np.uint64)
        self.width = np.diff(self.ends, prepend=0).astype(np.uint64)

    def learn(self, at: list[np.ndarray], ids: np.ndarray, of: np.ndarray, due: bool) -> None:
        """A round's ids, their contexts, and which chances came true."""
        for table, a in zip(self.best, at, strict=True):
            _follow(table, a, ids)
        self.mix(np.bincount(of, minlength=self.came.size))
        self.waiting.append(ids[of >= 2 * _PAIRS * _PASTS])
        if due:
            self.rank()


def _follow(table: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
    """Counts ``ids`` in their contexts ``at``: each keeps its best id (ties: the smallest), times of that and of all, within 63."""
    key = np.sort((at << 32) | (ids + 1))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    run = np.diff(first, append=len(key))
    key = key[first]
    place, who = key >> 32, key & 0xFFFFFFFF
    held = table.take(place)
    score = run + np.where(held >> 16 == who, (held >> 10) & 63, 0)
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    best = np.maximum.reduceat((score << 32) | (0xFFFFFFFF - who), begin)
    held, place = held[begin], place[begin]
    total = np.add.reduceat(run, begin) + ((held >> 4) & 63)
    score, who = best >> 32, 0xFFFFFFFF - (best & 0xFFFFFFFF)
    stays = (held >> 10) & 63 > score
    score, who = np.where(stays, (held >> 10) & 63, score), np.where(stays, held >> 16, who)
    many = np.flatnonzero(total > 63)
    score[many] = np.maximum(score[many] * 63 // total[many], 1)
    total[many] = 63
    times = (score << 6) | total
    table[place] = (who << 16) | (times << 4) | _LEVEL.take(times)


def _rounds(length: int) -> Iterator[tuple[int, int, bool]]:
    """First and last step of each round, and whether the frequencies are laid out anew after it."""
    at, laid = 0, 0
    while at < length:
        end = min(at + min(max(1, at >> 2), _ROUND), length)
        due = end * 4 >= laid * 5 and end < length
        laid = end if due else laid
        yield at, end, due
        at = end


def _shape(n: int) -> tuple[int, int]:
    """(lanes, ids per lane) for a block of ``n`` ids."""
    length = int(np.clip(-(-n // _LANES), *_LENGTH))
    return -(-n // length), length


class _Writer:
    def __init__(self, lanes: int, most: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.at = np.zeros(lanes, np.int64)
        self.words = np.zeros((most, lanes), np.uint64)

    def put(self, start: np.ndarray, width: np.ndarray, lanes: np.ndarray | slice) -> None:
        """Narrows the ranges of ``lanes`` and moves a word out of those that become too small."""
        low = self.low[lanes]
        moved = low + start
        over = np.flatnonzero(moved < low)
        if len(over):
            over = over if isinstance(lanes, slice) else lanes[over]
            self.words[self.at[over] - 1, over] += np.uint64(1)
        self.low[lanes], self.range[lanes] = moved, width
        full = np.flatnonzero(width < _FULL)
        self.send(full if isinstance(lanes, slice) else lanes[full])

    def send(self, lanes: np.ndarray) -> None:
        low = self.low[lanes]
        self.words[self.at[lanes], lanes] = low >> _WORD
        self.at[lanes] += 1
        self.low[lanes] = low << _WORD
        self.range[lanes] <<= _WORD

    def finish(self) -> np.ndarray:
        """The words of all lanes, one lane behind the other."""
        for _ in range(2):
            self.send(np.arange(len(self.low)))
        words = self.words[: self.at.max()]
        while (over := words >> _WORD).any():
            words &= _LOW
            words[:-1] += over[1:]
        return words.T[np.arange(len(words)) < self.at[:, None]].astype("<u4")


def _write(ids: np.ndarray) -> bytes:
    """One block."""
    n = len(ids)
    checksum = zlib.crc32(ids.astype("<u4").tobytes())
    listed = np.zeros(0, "<u4")
    ids = ids.astype(np.int64)
    if int(ids.max()) >= _DENSE:
        listed, ids = np.unique(ids, return_inverse=True)
        listed = listed.astype("<u4")
    top = int(ids.max()) + 1
    raw = np.uint64((top - 1).bit_length())
    lanes, length = _shape(n)
    padded = np.zeros(lanes * length, np.int64)
    padded[:n] = ids
    steps = np.ascontiguousarray(padded.reshape(lanes, length).T)
    before = np.concatenate([np.zeros((2, lanes), np.int64), steps + 1])
    model, out = _Model(n, top), _Writer(lanes, 2 * length + 2)
    outcome = np.zeros((length + 2, lanes), np.int64)
    scale, even = np.uint64(model.scale), np.uint64(_EVEN)
    everywhere = slice(None)
    for begin, end, due in _rounds(length):
        met = []
        for s in range(begin, end, _ROWS):
            e = min(s + _ROWS, end)
            now = steps[s:e]
            at = model.contexts(before[s + 1 : e + 1], before[s:e])
            id1, id2, sure = model.predict(at)
            right2 = now == id2
            miss = ~right2 & (now != id1)
            outcome[s + 2 : e + 2] = np.where(right2, 0, 1 + miss)
            cell = (sure << 4) | (outcome[s + 1 : e + 1] << 2) | outcome[s:e]
            of = outcome[s + 2 : e + 2] * (_PAIRS * _PASTS) + cell
            met.append((*at, of))
            start, width = model.upto.take(of), model.wide.take(of)
            width0 = model.width.take(now)
            start0 = np.where(miss, model.start.take(now), np.uint64(0))
            new = miss & (width0 == 0)
            if some := new.any():
                start0[new], width0[new] = model.start[top], model.width[top]
            for k in range(e - s):
                unit = out.range >> even
                narrow = unit * width[k]
                least = narrow >> scale
                out.put(unit * start[k] + least * start0[k], np.where(miss[k], least * width0[k], narrow), everywhere)
                if some and new[k].any():
                    own = np.flatnonzero(new[k])
                    unit = out.range[own] >> raw
                    out.put(unit * now[k][own].view(np.uint64), unit, own)
        at1, at2, of = (np.concatenate(x).reshape(-1) for x in zip(*met, strict=True))
        model.learn([at1, at2], steps[begin:end].reshape(-1), of, due)
    words = out.finish()
    return _HEAD.pack(n, length, top, len(listed), len(words), checksum) + listed.tobytes() + out.at.astype("<u2").tobytes() + words.tobytes()


def _read(coded: bytes, begin: int) -> tuple[np.ndarray, int]:
    """The ids of the block that begins at ``begin``, and where it ends."""
    if len(coded) < begin + _HEAD.size:
        raise ValueError("coded chunk of a wrong length")
    n, length, top, n_listed, n_words, checksum = _HEAD.unpack_from(coded, begin)
    begin += _HEAD.size
    if not (0 < n <= 2 * BLOCK_TOKENS and 0 < length <= _LENGTH[1] and 0 < top <= _DENSE):
        raise ValueError("not a coded block")
    lanes = -(-n // length)
    end = begin + 4 * n_listed + 2 * lanes + 4 * n_words
    if len(coded) < end:
        raise ValueError("coded chunk of a wrong length")
    listed = np.frombuffer(coded, "<u4", n_listed, begin)
    sizes = np.frombuffer(coded, "<u2", lanes, begin + 4 * n_listed).astype(np.int64)
    if sizes.sum() != n_words or (n_listed and n_listed < top):
        raise ValueError("coded block of a wrong length")
    words = np.append(np.frombuffer(coded, "<u4", n_words, begin + 4 * n_listed + 2 * lanes), np.zeros(2 * length + 4)).astype(np.uint64)
    raw = np.uint64((top - 1).bit_length())
    model = _Model(n, top)
    where = np.cumsum(sizes) - sizes
    code = (words[where] << _WORD) | words[where + 1]
    where += 2
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    steps = np.zeros((length, lanes), np.int64)
    scale, even = np.uint64(model.scale), np.uint64(_EVEN)
    last = np.uint64((1 << model.scale) - 1)
    one = two = past = np.zeros(lanes, np.int64)
    symbol = _symbols(model)

    def more(own: np.ndarray) -> None:
        to = where[own]
        code[own] = (code[own] << _WORD) | words.take(to, mode="clip")
        span[own] <<= _WORD
        where[own] = to + 1

    for s, e, due in _rounds(length):
        met = []
        for k in range(s, e):
            at = model.contexts(one, two)
            id1, id2, sure = model.predict(at)
            cell = (sure << 4) | past
            unit = span >> even
            end2, end1 = unit * model.upto[1].take(cell), unit * model.upto[2].take(cell)
            right2, miss = code < end2, code >= end1
            now = np.where(right2, id2, id1)
            below = np.where(right2, np.uint64(0), np.where(miss, end1, end2))
            span = np.where(right2, end2, np.where(miss, unit << even, end1)) - below
            code -= below
            m = np.flatnonzero(miss)
            if len(m):
                left, unit = code[m], span[m] >> scale
                got = symbol.take(np.minimum(left // unit, last).view(np.int64))
                code[m] = left - unit * model.start.take(got)
                span[m] = unit * model.width.take(got)
                now[m] = got
            more(np.flatnonzero(span < _FULL))
            if len(m) and (new := got == top).any():
                own = m[new]
                unit = span[own] >> raw
                got = np.minimum(code[own] // unit, np.uint64(top - 1))
                code[own] -= unit * got
                span[own] = unit
                now[own] = got.astype(np.int64)
                more(own[unit < _FULL])
            outcome = np.where(right2, 0, 1 + miss)
            past = ((outcome << 2) | (past >> 2)) & 15
            steps[k] = now
            one, two = now + 1, one
            met.append((*at, outcome * (_PAIRS * _PASTS) + cell))
        at1, at2, of = (np.concatenate(x) for x in zip(*met, strict=True))
        model.learn([at1, at2], steps[s:e].reshape(-1), of, due)
        if due:
            symbol = _symbols(model)
    ids = steps.T.reshape(-1)[:n]
    ids = (listed[ids] if n_listed else ids).astype("<u4")
    if zlib.crc32(ids.tobytes()) != checksum:
        raise ValueError("a block of a coded chunk fails its checksum")
    return ids, end


def _symbols(model: _Model) -> np.ndarray:
    """The id whose interval holds each place of the frequencies' scale."""
    return np.repeat(np.arange(model.top + 1, dtype=np.int32), model.width.astype(np.int64)).astype(np.int32)


def encode(ids: np.ndarray) -> bytes:
    """The coded chunk."""
    each = -(-len(ids) // max(1, round(len(ids) / BLOCK_TOKENS)))
    return _MAGIC + struct.pack("<I", len(ids)) + b"".join(_write(ids[s : s + each]) for s in range(0, len(ids), each or 1))


def decode(chunk: bytes) -> np.ndarray:
    """The ids of a coded chunk.  A chunk with a wrong checksum or form is an error, never other ids."""
    if chunk[:4] != _MAGIC or len(chunk) < 8:
        raise ValueError("not a coded chunk")
    (n,) = struct.unpack_from("<I", chunk, 4)
    at, blocks = 8, [np.zeros(0, "<u4")]
    while at < len(chunk):
        ids, at = _read(chunk, at)
        blocks.append(ids)
    if sum(map(len, blocks)) != n:
        raise ValueError("coded chunk of a wrong length")
    return np.concatenate(blocks)
