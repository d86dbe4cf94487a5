"""Substring dedup: words covered by a window of 35 words that also starts elsewhere are removed.

Rabin-Karp hashes of every window are counted in two rounds over the same blocks of documents.
The first counts 32 bits per window within a bucket (``counting``), which leaves the repeated
windows and about one stranger in a thousand; the second counts those left by two independent
61-bit hashes.  Neighbouring repeated windows then merge into maximal intervals, and the words
outside them are kept.  The documents are shuffled once: the three uses share one exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablemend.llm import counting
from tablemend.llm.words import (
    BASES,
    fingerprints,
    in_blocks,
    n_blocks,
    ordered,
    rolling,
    size_of,
    split_words,
    text_column,
    window_starts,
)

WINDOW = 35
_EXACT = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("starts", pa.binary())])
_FOUND = pa.schema([("block_id", pa.int64()), ("starts", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


class _Block:
    """The windows of a block's documents."""

    def __init__(self, block: pa.Table, window: int):
        self.rows = ordered(block)
        self.words, self.counts = split_words(text_column(self.rows["text"]))
        self.starts = window_starts(self.counts, window)
        self.marks = fingerprints(self.words)
        self.window = window

    def hashes(self, which: int) -> np.ndarray:
        every = rolling(self.marks[which], self.window, BASES[which])
        return every[self.starts]


def _candidates(block: _Block, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that the first round left, and their first hash."""
    first = block.hashes(0)
    if not len(first):
        return np.zeros(0, np.int64), first
    totals = counting.Coded(first, buckets).totals(answers["bucket"].to_pylist(), answers["totals"].to_pylist())
    found = np.flatnonzero(totals > 1)
    return found, first[found]


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (a, b), and where in that order a new pair begins."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _count_exactly(bucket: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x, np.uint64).reshape(2, -1) for x in bucket["keys"].to_pylist()], axis=1)
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in bucket["counts"].to_pylist()])
    starts = [np.frombuffer(x, np.uint32) for x in bucket["starts"].to_pylist()]
    order, new = _same(keys[0], keys[1])
    group = np.cumsum(new) - 1
    total = np.empty(len(order), np.float64)
    total[order] = np.bincount(group, weights=counts[order])[group]
    ends = np.cumsum([len(s) for s in starts])
    found = [s[total[e - len(s) : e] > 1].tobytes() for s, e in zip(starts, ends, strict=True)]
    return pa.table([bucket["block_id"], pa.array(found, pa.binary())], schema=_FOUND)


def _outcome(block: _Block, confirmed: np.ndarray, with_text: bool) -> pa.Table:
    """One row per document, given the starts (as window numbers) of repeated windows."""
    n = len(block.words)
    edge = np.zeros(n + 1, np.int32)
    at = block.starts[confirmed]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    offsets = np.frombuffer(block.words.buffers()[1], np.int64)[: n + 1]
    letters = np.frombuffer(block.words.buffers()[2], np.uint8) if n else np.zeros(0, np.uint8)
    kept = ~gone
    lengths = np.diff(offsets)
    spaced = np.full(len(letters) + n, 32, np.uint8)  # each word followed by a space
    is_letter = np.ones(len(spaced), bool)
    is_letter[offsets[1:] + np.arange(n)] = False
    spaced[is_letter] = letters
    flat = spaced[np.repeat(kept, lengths + 1)].tobytes()
    ends = np.concatenate([[0], np.cumsum(np.where(kept, lengths + 1, 0))])
    bounds = np.concatenate([[0], np.cumsum(block.counts)])
    pieces = [flat[ends[s] : max(ends[s], ends[e] - 1)] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    removed = np.concatenate([[0], np.cumsum(gone)])
    turns = np.diff(gone.astype(np.int8), prepend=0, append=0)
    fresh, last = np.flatnonzero(turns[:-1] == 1), np.flatnonzero(turns == -1)
    spans: list = [None] * len(pieces)
    if with_text:
        spans = []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            i, j = np.searchsorted(last, s, "right"), np.searchsorted(fresh, e)
            spans.append([{"start": max(int(a), s) - s, "end": min(int(b), e) - s} for a, b in zip(fresh[i:j], last[i:j], strict=True)])
    return pa.table(
        [
            block.rows["doc_id"].cast(pa.int64()),
            pa.array(block.counts, pa.int64()),
            pa.array(np.diff(removed[bounds]), pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string()),
            pa.array([p.decode("utf-8", "replace") for p in pieces] if with_text else [None] * len(pieces), pa.string()),
            pa.array(spans, _OUT.field("removed").type),
        ],
        schema=_OUT,
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256, kept_text and the removed
    word intervals [start, end).

    A missing or empty text has no words.  A text shorter than the window keeps all of them.  A
    repeated row removes itself and its copy, as the window starts elsewhere too.  Other columns of
    ``docs`` are not looked at, whatever their names.  ``with_text`` False leaves the last two null.
    """
    total_bytes, _ = size_of(docs)
    blocks = in_blocks(docs, n_blocks(docs, total_bytes))
    buckets = counting.n_buckets(docs, total_bytes // 5)

    def first_round(block: pa.Table) -> pa.Table:
        b = _Block(block, window)
        return counting.Coded(b.hashes(0), buckets).table(block["block_id"][0].as_py())

    def second_round(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(answers) or not len(block):
            return _EXACT.empty_table()
        b = _Block(block, window)
        found, one = _candidates(b, answers, buckets)
        two = b.hashes(1)[found]
        order, new = _same(one, two)
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(order))).astype(np.uint32)
        first = order[heads]
        one, two, starts = one[first], two[first], found[first].astype(np.uint32)
        bucket = (two % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        rows = []
        for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            if len(part):
                rows.append((int(bucket[part[0]]), block["block_id"][0].as_py(), np.stack([one[part], two[part]]).tobytes(), counts[part].tobytes(), starts[part].tobytes()))
        return pa.Table.from_pylist([dict(zip(_EXACT.names, r, strict=True)) for r in rows], schema=_EXACT)

    def outcome(block: pa.Table, found: pa.Table) -> pa.Table:
        if not len(block):
            return _OUT.empty_table()
        b = _Block(block, window)
        starts = np.frombuffer(b"".join(found["starts"].to_pylist()), np.uint32).astype(np.int64)
        if len(starts):  # a start stands for all windows of the block that equal it
            one = b.hashes(0)
            like = np.flatnonzero(np.isin(one, one[starts]))
            one, two = one[like], b.hashes(1)[like]
            order, new = _same(one, two)
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            hit = np.zeros(len(order) + 1, bool)
            hit[group[np.searchsorted(like, starts)]] = True
            starts = like[hit[group]]
        return _outcome(b, starts, with_text)

    keys = blocks.groupBy("block_id").applyInArrow(first_round, counting.KEYS)
    answers = counting.add_up(keys)
    exact = blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(second_round, "bucket int, block_id long, keys binary, counts binary, starts binary")
    found = exact.groupBy("bucket").applyInArrow(_count_exactly, "block_id long, starts binary")
    return blocks.groupBy("block_id").cogroup(found.groupBy("block_id")).applyInArrow(
        outcome, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:long,end:long>>"
    )
