"""How often does each of many billions of keys occur in the whole corpus?

Keys never become rows.  A block sends, for each bucket of the key space, the sorted distinct
32-bit residuals of its keys there with their counts in the block; the bucket's task adds up the
counts of equal residuals and answers with one byte per key sent; the block puts the answers back
in place.  A key held by a third of all rows thus costs at most one entry per block.  Buckets
grow in number with the corpus, so the share of keys that meet a stranger with the same residual
stays near ``BUCKET_KEYS`` / 2^32: answers are never too low, and callers settle the rest exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablemend.llm.words import partitions

BUCKET_KEYS = 4_000_000
KEYS = "bucket int, block_id long, residuals binary, counts binary"
ANSWERS = "block_id long, bucket int, totals binary"
MOST = 255  # totals from here on are not told apart
_TO_ARROW = {
    "keys": pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("residuals", pa.binary()), ("counts", pa.binary())]),
    "answers": pa.schema([("block_id", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary())]),
}


def n_buckets(df: DataFrame, keys: int) -> int:
    return max(partitions(df), keys // BUCKET_KEYS + 1)


class Coded:
    """A block's keys as (bucket, residual): distinct ones in order, and each key's place among them."""

    def __init__(self, keys: np.ndarray, buckets: int):
        n = np.uint64(buckets)
        coded = ((keys % n) << np.uint64(32)) | ((keys // n) & np.uint64(0xFFFFFFFF))
        self.codes, self.place, self.counts = np.unique(coded, return_inverse=True, return_counts=True)
        self.bucket = (self.codes >> np.uint64(32)).astype(np.int64)
        self.edges = np.flatnonzero(np.diff(self.bucket, prepend=-1))

    def rows(self, block_id: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        ends = np.append(self.edges[1:], len(self.codes))
        residuals = self.codes.astype(np.uint32)
        counts = np.minimum(self.counts, 65535).astype(np.uint16)
        for s, e in zip(self.edges, ends, strict=True):
            yield int(self.bucket[s]), block_id, residuals[s:e].tobytes(), counts[s:e].tobytes()

    def table(self, block_id: int) -> pa.Table:
        return keys_table(list(self.rows(block_id)))

    def totals(self, buckets: list[int], answers: list[bytes]) -> np.ndarray:
        """The corpus total of each of the block's keys, in their original order."""
        whole = np.frombuffer(b"".join(a for _, a in sorted(zip(buckets, answers, strict=True))), np.uint8)
        return whole[self.place]


def keys_table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TO_ARROW["keys"].types, strict=True)], schema=_TO_ARROW["keys"]) if rows else _TO_ARROW["keys"].empty_table()


def _add_up(bucket: pa.Table) -> pa.Table:
    residuals = [np.frombuffer(x, np.uint32) for x in bucket["residuals"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint16) for x in bucket["counts"].to_pylist()])
    _, place = np.unique(np.concatenate(residuals), return_inverse=True)
    totals = np.minimum(np.bincount(place, weights=counts), MOST).astype(np.uint8)[place]
    ends = np.cumsum([len(r) for r in residuals])
    answers = [totals[e - len(r) : e].tobytes() for e, r in zip(ends, residuals, strict=True)]
    return pa.table([bucket["block_id"], bucket["bucket"], pa.array(answers, pa.binary())], schema=_TO_ARROW["answers"])


def add_up(keys: DataFrame) -> DataFrame:
    """Answers to the key rows of all blocks."""
    return keys.groupBy("bucket").applyInArrow(_add_up, ANSWERS)
