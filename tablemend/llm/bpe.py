"""Byte-level BPE encoding and decoding with a local rank file, through the tiktoken library.

Texts above ``SEGMENT`` characters are cut where the pattern surely begins a new match, so that
the library's matcher never meets a text it cannot hold (it overflows on long white space) and
memory follows the segment.  The cuts are safe because no alternative of the pattern crosses them:

* before white space that follows anything else: only white space alternatives hold white space
  behind their first character, and those hold nothing else;
* before the last white space of a run that something else follows: the look-ahead makes the
  match of the run end there, and at the end of a segment it ends there too;
* between an ASCII letter and an ASCII digit: no alternative holds both.

A whole run of white space is one match, so a long one is merged directly, without the matcher.
Text between two cuts is one match or a few; it is passed on whole, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1 << 16
_CUT = regex.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=\s)(?=\s\S)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_MATCHER_HOLDS = 4096  # white space in a row that the matcher certainly takes
_LONG_RUN = regex.compile(r"\s{%d,}+" % _MATCHER_HOLDS)
_built: dict[tuple[bytes, str], tiktoken.Encoding] = {}


def read_ranks(path: str) -> bytes:
    """The rank file, which the tasks get by broadcast: its size is the vocabulary's, not the data's."""
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The tokenizer, built once in each Python worker."""
    if (ranks, pattern) not in _built:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _built[ranks, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _built[ranks, pattern]


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """``text`` in pieces, each cut at the first safe place behind ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _runs_apart(piece: str) -> Iterator[tuple[str, bool]]:
    """``piece`` in parts, and whether a part is a long run of white space that is one match: the
    whole run, but for the last space if something follows."""
    at = 0
    for run in _LONG_RUN.finditer(piece):
        end = run.end() if run.end() == len(piece) else run.end() - 1
        if run.start() > at:
            yield piece[at : run.start()], False
        yield piece[run.start() : end], True
        at = end
    if at < len(piece):
        yield piece[at:], False


def token_ids(text: str, by: tiktoken.Encoding, segment: int = SEGMENT) -> np.ndarray:
    """The ids of one text, as the library would give for the whole of it."""
    if len(text) <= min(_MATCHER_HOLDS, segment):
        return np.array(by.encode_ordinary(text), "<u4")
    ids: list[int] = []
    for piece in segments(text, segment):
        for part, is_run in _runs_apart(piece):
            ids += by._encode_single_piece(part) if is_run else by.encode_ordinary(part)
    return np.array(ids, "<u4")


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, as ids and texts are Python objects here."""
    return (batch.slice(s, rows) for s in range(0, batch.num_rows, rows))


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row; ``ids`` are little-endian unsigned 32-bit integers.

    A missing or empty text has no ids.  Other columns of ``docs`` are not looked at.  Repeated
    rows give repeated rows.
    """
    return _mapped(docs, ranks, pattern, (_encoded,), "n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``: the raw bytes that its ``ids`` stand for.  Bytes, as ids may be
    cut anywhere, also within a character.  Missing ids give no bytes."""
    held = encoded.sparkSession.sparkContext.broadcast(ranks)
    out = encoded.drop("decoded")
    return out.mapInArrow(lambda batches: _decoded(batches, encoding(held.value, pattern)), out.withColumn("decoded", F.lit(b"")).schema)


def there_and_back(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """:func:`decode` of :func:`encode`, in one Python worker: (doc_id, n_tokens, ids, decoded)."""
    return _mapped(docs, ranks, pattern, (_encoded, _decoded), "n_tokens long, ids binary, decoded binary")


def _mapped(docs: DataFrame, ranks: bytes, pattern: str, steps: tuple[Callable, ...], made: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches, encoding(held.value, pattern))
        return batches

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {made}")


def _encoded(batches: Iterator[pa.RecordBatch], by: tiktoken.Encoding) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in _slices(b):
            ids = [token_ids(t or "", by) for t in part["text"].to_pylist()]
            yield pa.record_batch([part["doc_id"], pa.array(map(len, ids), pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], by: tiktoken.Encoding) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in _slices(b):
            raw = [by.decode_bytes(np.frombuffer(i or b"", "<u4").tolist()) for i in part["ids"].to_pylist()]
            yield part.append_column("decoded", pa.array(raw, pa.binary()))


def vocabulary(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """Rank file and pattern of an installed public tokenizer."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN
