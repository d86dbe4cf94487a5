"""Token-ID files: documents' ids in ascending doc_id order, in chunks of the range coder's blocks.

Rows are dealt out by ranges of doc_id and sorted within, so the files follow each other in order.
Each row of a file is a chunk: whole documents, up to a bounded number of ids or one longer document,
with their doc_ids, their lengths and one coded payload (``idcoder``).  The container is Parquet, which
any store that Spark can write to takes, and which commits whole files only.

Words are encoded when they are first met and put together again: the tokenizer drops white space and
joins nothing across it, so a text's ids are those of its words.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemend.llm import idcoder
from tablemend.llm.words import pieces, split_words, text_column

END_ID = 2
_CHUNK = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
_CHUNK_SQL = "part int, chunk int, doc_ids array<long>, lengths array<long>, payload binary"
_HELD_WORDS = 1_000_000
_PIECE = 6 << 20  # bytes of text whose words are looked up at once
_GROUP = 100  # words encoded together
_MARK = "\x01"
_ONE_SPACE = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_DIGIT = 2
_loaded: dict = {}


class _Words:
    """The tokenizer with the ids of words met before, as many as fit; one per Python worker."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.by = Tokenizer.from_str(model)
        self.spaced = Tokenizer.from_str(_unspaced(model))
        mark = self.by.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.kinds, self.final = _kinds(model, self.by.get_vocab())
        self.words = pa.array([], pa.large_binary())
        self.flat, self.ends, self.used, self.turn = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), 0

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and the number per text."""
        words, counts = self._cut(*split_words(text_column(texts)))
        coded = words.dictionary_encode()
        own = coded.dictionary
        if len(self.words) > _HELD_WORDS:
            self._forget()
        found = pc.index_in(own, value_set=self.words)
        new = np.asarray(pc.is_null(found))
        place = np.asarray(pc.fill_null(found, 0), np.int64)
        if found.null_count:
            place[new] = len(self.words) + self._add(own.filter(pa.array(new)))
        self.turn += 1
        self.used[place] = self.turn
        place = place[np.asarray(coded.indices)]
        stream, sums = self._of(place)
        return stream, np.diff(sums[np.append(0, np.cumsum(counts))])

    def _of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of held words one behind the other, and how many stand before each and in all."""
        first = self.ends[place]
        times = self.ends[place + 1] - first
        sums = np.append(0, np.cumsum(times))
        return self.flat[np.repeat(first - sums[:-1], times) + np.arange(int(sums[-1]))], sums

    def _cut(self, words: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """``words`` cut between two bytes of different kinds, and the number per text."""
        if not self.kinds.any() or not len(words):
            return words, counts
        at = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
        kind = self.kinds[np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]]]
        begins = np.zeros(len(kind), bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (np.minimum(kind[1:], kind[:-1]) > 0)
        begins[at[:-1]] = True
        starts = np.flatnonzero(begins)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, at[-1])), words.buffers()[2]])
        return parts, np.diff(np.searchsorted(starts, at[np.append(0, np.cumsum(counts))]))

    def _add(self, new: pa.Array) -> np.ndarray:
        """Encodes words and holds them behind the others, at the places given back."""
        at = np.frombuffer(new.buffers()[1], np.int64)[new.offset : new.offset + len(new) + 1]
        raw = new.buffers()[2].to_pybytes()
        kind = self.kinds[np.frombuffer(raw, np.uint8)[at[0] : at[-1]]]
        plain = np.minimum.reduceat(kind, at[:-1] - at[0])
        words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        single = plain > 0
        if self.kinds.any():
            single[~single] = [words[k].isalpha() for k in np.flatnonzero(~single)]
        order = np.argsort(~single, kind="stable")
        n_plain = np.count_nonzero(single)
        words = [words[k] for k in order.tolist()]
        parts = np.where(plain == _DIGIT, np.diff(at), 1)[order]
        got = [self._plain(words[s:e], parts[s:e]) for s, e in _spans(0, n_plain)] + [self._marked(words[s:e]) for s, e in _spans(n_plain, len(words))]
        ids, sizes = zip(*got, strict=True)
        self.flat = np.concatenate([self.flat, *ids])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes)))
        self.words = pa.concat_arrays([self.words, new.take(pa.array(order))])
        self.used = np.append(self.used, np.zeros(len(new), np.int64))
        place = np.empty(len(new), np.int64)
        place[order] = np.arange(len(new))
        return place

    def _plain(self, words: list[str], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and the number per word, each of which has ``parts`` final ids or, of letters that are not all ASCII, one or more."""
        ids = np.array(self.spaced.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        finals = np.flatnonzero(self.final[ids])
        each = np.cumsum(parts)
        if len(finals) != each[-1]:
            return self._marked(words)
        return ids, np.diff(finals[each - 1] + 1, prepend=0)

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of any words and the number per word: of all together, a mark behind each, where the mark's id tells them apart."""
        if self.mark is not None:
            text = f" {_MARK} ".join([*words, ""])
            by = self.spaced if text.split()[::2] == words else self.by
            ids = np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(words):
                return ids[ids != self.mark], np.diff(marks, prepend=-1) - 1
        lists = [e.ids for e in self.by.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)

    def _forget(self) -> None:
        """Keeps the half of the words that came last."""
        keep = np.sort(np.argpartition(self.used, -(_HELD_WORDS // 2))[-(_HELD_WORDS // 2) :])
        self.flat, self.ends = self._of(keep)
        self.words, self.used = self.words.take(pa.array(keep)), self.used[keep]


def _spans(start: int, end: int) -> Iterator[tuple[int, int]]:
    return ((s, min(s + _GROUP, end)) for s in range(start, end, _GROUP))


def _unspaced(model: str) -> str:
    """``model`` without the step that makes white space one space, for texts in which there is no other."""
    parsed = json.loads(model)
    steps = (parsed.get("normalizer") or {}).get("normalizers", [])
    steps[:] = [s for s in steps if s != _ONE_SPACE]
    return json.dumps(parsed)


def _kinds(model: str, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and which ids end a match of the tokenizer's pattern.

    A match never goes on from an ASCII letter, digit or mark to one of another kind; a word of letters or
    of marks alone is one match, digits are one each.  This holds for the pattern below; with any other,
    and for the bytes of added tokens and the apostrophe, the kind is 0, of which nothing is said.
    """
    none = np.zeros(256, np.uint8), np.zeros(0, bool)
    parsed = json.loads(model)
    steps, added, bpe = (parsed.get("normalizer") or {}).get("normalizers", []), parsed.get("added_tokens", []), parsed["model"]
    cuts, suffix = (parsed.get("pre_tokenizer") or {}).get("pretokenizers", []), bpe.get("end_of_word_suffix")
    known = [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
    if [{k: v for k, v in c.items() if k != "trim_offsets"} for c in cuts] != known or any(s not in ({"type": "NFC"}, {"type": "Lowercase"}, _ONE_SPACE) for s in steps):
        return none
    if bpe["type"] != "BPE" or not suffix or any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")) or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return none
    if sum(len(t) == 1 + len(suffix) and t.endswith(suffix) for t in vocabulary) < 256:  # every byte can end a match
        return none
    names = "".join(t["content"] for t in added)
    kinds = np.zeros(256, np.uint8)
    for kind, letters in ((1, string.ascii_letters), (_DIGIT, string.digits), (3, string.punctuation)):
        for c in letters:
            if c != "'" and (kind == 1 or c not in names):
                kinds[ord(c)] = kind
    for t in added:  # nothing is cut within an added token, nor is it taken for a word of one kind
        kind = kinds[np.frombuffer(t["content"].encode(), np.uint8)]
        if not len(kind) or kind.all() or ((kind[1:] != kind[:-1]) & (np.minimum(kind[1:], kind[:-1]) > 0)).any():
            return none
    final = np.zeros(max(vocabulary.values()) + 1, bool)
    final[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
    return kinds, final


def _tokenizer(model: str) -> _Words:
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = _Words(model)
    return _loaded[model]


def write_ids(docs: DataFrame, model: str, path: str, end_id: int = END_ID, chunk_tokens: int = idcoder.CHUNK_TOKENS) -> None:
    """Writes the ids of every row of ``docs`` (doc_id, text), ``end_id`` behind each, to ``path``.

    ``model`` is the tokenizer's JSON, which goes to the tasks by broadcast.  Missing and empty texts
    have only the end id.  Rows without doc_id come first; rows that share one are in order of their
    texts.  Other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, part, chunk = _tokenizer(held.value), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        streams: list[np.ndarray] = []
        waiting = 0

        def send() -> pa.RecordBatch:
            payload = idcoder.encode(np.concatenate(streams))
            return pa.record_batch([pa.array([x], t) for x, t in zip((part, chunk, doc_ids, lengths, payload), _CHUNK.types, strict=True)], schema=_CHUNK)

        for b in (p for whole in batches for p in pieces(whole, _PIECE)):
            stream, counts = by.ids(b["text"])
            ends = np.cumsum(counts)
            with_end = np.insert(stream, ends, end_id)
            lengths += (counts + 1).tolist()
            doc_ids += b["doc_id"].to_pylist()
            streams.append(with_end.astype(np.uint32))
            waiting += len(with_end)
            if waiting >= chunk_tokens:
                yield send()
                chunk, waiting = chunk + 1, 0
                doc_ids, lengths, streams = [], [], []
        if doc_ids:
            yield send()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text").mapInArrow(run, _CHUNK_SQL).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document in the files at ``path``: doc_id, start (ids of all documents before it), n_tokens,
    ids (little-endian unsigned 32-bit integers; none ``with_ids`` false, though all are read) and ids_crc32."""
    chunks = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                ids = memoryview(idcoder.decode(row["payload"]).astype("<u4")).cast("B")
                ends = np.cumsum(row["lengths"])
                pieces = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), row["lengths"], strict=True)]
                n = len(pieces)
                columns = [
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - row["lengths"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()), pa.array(map(bytes, pieces), pa.binary()) if with_ids else pa.nulls(n, pa.binary()), pa.array(map(zlib.crc32, pieces), pa.int64()),
                ]
                out = pa.record_batch(columns, ["part", "chunk", "doc_id", "_own", "n_tokens", "ids", "ids_crc32"])
                yield from (out.slice(s, 1000) for s in range(0, n, 1000))

    docs = chunks.mapInArrow(run, "part int, chunk int, doc_id long, _own long, n_tokens long, ids binary, ids_crc32 long")
    totals = chunks.select("part", "chunk", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = (Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))  # a row per file
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("_before_part"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(*before)), F.lit(0))
    at = totals.withColumn("_before_chunk", within).join(parts, "part").select("part", "chunk", (F.col("_before_part") + F.col("_before_chunk")).alias("_before"))
    return docs.join(at, ["part", "chunk"]).select("doc_id", (F.col("_before") + F.col("_own")).alias("start"), "n_tokens", "ids", "ids_crc32")
