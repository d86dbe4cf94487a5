"""Words, window hashes and block layout shared by the text operators.

Work inside a task is array code over blocks of documents: a block is a bounded number of bytes
of whole texts, chosen by a hash of the row so that any run places it alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 6 << 20
PIECE_BYTES = 2 << 20
# Memory that a task is done with goes back to the system, as workers stay for later tasks.
pa.set_memory_pool(pa.system_memory_pool())
PRIME = (1 << 61) - 1  # modulus of the rolling hashes
_SLICE = 1 << 15  # windows hashed at once, to stay in the processor's cache
_M30, _M31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_P = np.uint64(PRIME)


def text_column(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of byte strings; a missing text becomes an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    return pc.fill_null(texts.cast(pa.large_binary()), b"")


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of text, or one longer text: what array code
    over its words holds at once."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0), np.int64)
    run = np.cumsum(sizes) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [batch.num_rows]])
    return (batch.slice(s, e - s) for s, e in zip(cuts[:-1], cuts[1:], strict=True) if e > s)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of bytes other than 0x20 and 0x09-0x0D) of ``texts`` in order, and the number per text."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    letters = data[inside]
    if lower:
        letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
    offsets = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words, np.diff(np.searchsorted(starts, at))


def fingerprints(words: pa.Array) -> np.ndarray:
    """(2, n) residues below PRIME for each word: two independent 61-bit values of a 128-bit digest."""
    coded = words.dictionary_encode()
    digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
    pairs = np.frombuffer(digests, "<u8").reshape(-1, 2).T % _P
    return pairs[:, np.asarray(coded.indices, dtype=np.int64)] if len(words) else np.zeros((2, 0), np.uint64)


def _times(a: np.ndarray, c: int) -> np.ndarray:
    """a * c modulo PRIME."""
    hi, lo = np.uint64(c >> 31), np.uint64(c & 0x7FFFFFFF)
    a_hi, a_lo = a >> np.uint64(31), a & _M31
    mid = a_hi * lo + a_lo * hi
    r = ((a_hi * hi) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _M30) << np.uint64(31)) + a_lo * lo
    r = (r & _P) + (r >> np.uint64(61))
    return np.where(r >= _P, r - _P, r)


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    r = a + b
    return np.where(r >= _P, r - _P, r)


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each ``size`` consecutive values: the sum of value * base^k modulo PRIME.

    Windows of doubled length are put together from two halves, so a size of n takes about
    2 log2(n) passes instead of n.
    """
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for s in range(0, n, _SLICE):
        doubled, length = values[s : min(s + _SLICE, n) + size - 1], 1
        whole, covered = None, 0
        rest = size
        while rest:
            if rest & 1:
                part = doubled if whole is None else doubled[covered : covered + len(whole)]
                if whole is None:
                    whole, covered = part, length
                else:
                    m = min(len(whole), len(doubled) - covered)
                    whole = _plus(_times(whole[:m], pow(base, length, PRIME)), doubled[covered : covered + m])
                    covered += length
            rest >>= 1
            if rest:
                doubled = _plus(_times(doubled[:-length], pow(base, length, PRIME)), doubled[length:])
                length *= 2
        out[s : s + _SLICE] = whole[: min(_SLICE, n - s)]
    return out


def window_starts(counts: np.ndarray, size: int) -> np.ndarray:
    """Word positions at which a window of ``size`` words lies within one text."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(np.arange(len(ends)) + size <= ends)


BASES = (1_234_567_891_011_121_3 % PRIME, 987_654_321_234_567_89 % PRIME)  # one per modulus-61 hash


def size_of(docs: DataFrame) -> tuple[int, int]:
    """(bytes of text, rows): what block and bucket numbers follow from."""
    row = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int(row["b"] or 0), int(row["n"])


def partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def n_blocks(docs: DataFrame, total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(partitions(docs), total_bytes // block_bytes + 1)


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block_id, doc_id, text); the block follows from the row itself."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block_id"), "doc_id", "text")


def ordered(block: pa.Table) -> pa.Table:
    """The block's rows in an order that does not depend on how they arrived."""
    return block.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def word_pattern() -> str:
    """A word as a Java regular expression: what split_words takes."""
    return r"[^ \t-\r]+"


def normalised(text: Column) -> Column:
    """Each run of 0x20 and 0x09-0x0D as one space; a missing text as an empty one."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", " ")


def joined(words: pa.Array, counts: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The text of each document: those of its words that are ``kept``, one space between them."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[: n + 1]
    letters = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]] if n else np.zeros(0, np.uint8)
    sizes = np.where(kept, np.diff(offsets), 0)
    ends = np.cumsum(counts)
    each = np.cumsum(kept)
    total = np.append(0, each)[ends]  # words kept up to each document's end
    last = np.zeros(n, bool)  # the last kept word of a document has no space behind it
    has = np.diff(total, prepend=0) > 0
    last[np.searchsorted(each, total[has])] = True
    spaced = sizes + (kept & ~last)
    out = np.full(int(spaced.sum()), 32, np.uint8)
    begin = np.cumsum(spaced) - spaced
    if len(out):
        flat = letters[np.repeat(kept, np.diff(offsets))]
        out[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    at = np.append(0, np.append(0, np.cumsum(spaced))[ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(out)])
