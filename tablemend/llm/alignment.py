"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, and in how many documents.

Both tokenizers cover the same bytes of a text.  Offsets where a token of each ends cut the tokens into
groups; every pair of a group is a link.  No group crosses a single space between other characters, so a text's groups
are those of its stretches between such spaces, and a block of documents has each distinct stretch
tokenized once.  Links are inverted per block of documents: a pair of ids gets a
compressed bitmap of the block's documents that hold it linked (a list of places, or bits where more than one
document in 16 holds it), and a document with several links of the pair is also in the planes of
a binary counter, bitmaps of the same kind.  The bitmaps of a block are the OR of those of its texts' pieces.
Blocks share no document, so the popcount of a pair's bitmaps over all blocks is the sum of the popcounts, and
only these cross the network: they are added up with map-side combining.  For its scores each block then
asks for its own pairs, one row per pair and block however many documents hold it, and its postings, plane by
plane, hand them to the documents.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemend.llm.words import pieces
from tablemend.session import cut_lineage

BLOCK_BYTES = 4 << 20  # of text whose postings are one row
SLICE_BYTES = 1 << 18  # of text whose tokens are Python objects at once
BLOCK_DOCS = 1 << 16  # places within a block have 16 bits
RUN_BYTES = 1 << 12  # of stretches encoded side by side
LINKS_AT_ONCE = 1 << 20
_BITS = 20  # of an id within a pair's code
_DENSE = 16  # bits are shorter than a list from one document in so many
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_OTHER = regex.compile(r"^ | $|\s | \s")  # a space that is no cut
_loaded: dict = {}


def read_models(a: str, b: str) -> tuple[str, bytes]:
    """A byte-level BPE as JSON (tokenizers) and a SentencePiece model: broadcast, sized by their vocabularies."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return f.read(), g.read()


class _Vocabulary:
    """The bytes that ids stand for."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) > 1 << _BITS:
            raise ValueError(f"at most {1 << _BITS} ids")
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.starts[ids], self.sizes[ids])]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Tokenizers:
    """Both, built once in each Python worker."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True  # their strings are text like any other
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 255 and c != 173]  # bytes that byte-level BPE writes as themselves
        hidden = [c for c in range(256) if c not in set(shown)]
        byte_of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(hidden)}
        names = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        tokens = [b""] * (names[-1][0] + 1)
        for i, t in names:
            tokens[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        self.a_bytes = _Vocabulary(tokens)
        b_ids = range(self.b.get_piece_size())
        self.b_bytes = _Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in (self.b.id_to_piece(i),)])
        most = max(len(self.a_bytes.sizes), len(self.b_bytes.sizes))
        self.decimal = _Vocabulary([b"%d," % i for i in range(most)])

    def ids(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids and number of ids per text, of space + text by A and of text by B (which adds the space)."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return _flat(a), _flat(self.b.encode(texts, num_threads=1))

    def ids_of_stretches(self, own: list[str], sizes: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """:meth:`ids` of stretches, ``sizes`` bytes long with their space.  They are encoded side by side in
        one text, which gives the same ids where no white space stands beside the space between two, as tokens of
        several spaces would cross it; so a run ends there.  Where the ids do not spell the text, each by itself."""
        bare = np.array([bool(t) and not t[0].isspace() and not t[-1].isspace() for t in own], bool)
        beside = np.append(False, bare[1:] & bare[:-1])  # the one before
        runs = np.flatnonzero((np.diff(np.cumsum(sizes) // RUN_BYTES, prepend=-1) != 0) | ~beside)
        ends = np.append(runs[1:], len(own))
        texts = [" ".join(own[s:e]) for s, e in zip(runs.tolist(), ends.tolist(), strict=True)]
        good, found = self.spells(texts, self.ids(texts), np.add.reduceat(sizes, runs))
        bad = np.flatnonzero(~good)
        alone = self.ids([t for k in bad.tolist() for t in own[runs[k] : ends[k]]]) if len(bad) else None
        is_alone = np.repeat(~good, ends - runs)
        edges = np.cumsum(sizes[~is_alone])
        out = []
        for side, vocabulary in enumerate((self.a_bytes, self.b_bytes)):
            ids = found[side][0][np.repeat(good, found[side][1])]
            counts = np.zeros(len(own), np.int64)
            counts[~is_alone] = np.diff(np.searchsorted(np.cumsum(vocabulary.sizes[ids]), edges, "right"), prepend=0)
            if alone is not None:
                counts[is_alone] = alone[side][1]
                of_alone = np.repeat(is_alone, counts)
                mixed = np.empty(len(of_alone), np.int64)
                mixed[of_alone], mixed[~of_alone] = alone[side][0], ids
                ids = mixed
            out.append((ids, counts))
        return tuple(out)

    def spells(self, texts: list[str], found: tuple, sizes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Which of the texts the tokens of both spell as space + text; and ``found`` itself."""
        want = np.frombuffer((" " + " ".join(texts)).encode("utf-8", "surrogatepass"), np.uint8)
        starts = np.append(0, np.cumsum(sizes))
        fits = np.ones(len(texts), bool)
        for (ids, n), vocabulary in zip(found, (self.a_bytes, self.b_bytes), strict=True):
            edges = np.append(0, np.cumsum(vocabulary.sizes[ids]))[np.append(0, np.cumsum(n))]
            fits &= np.diff(edges) == sizes
            spelled = vocabulary.spelled(ids)
            left = np.flatnonzero(fits)
            same = spelled[_ranges(edges[left], sizes[left])] == want[_ranges(starts[left], sizes[left])]
            fits[left] = np.logical_and.reduceat(same, np.cumsum(sizes[left]) - sizes[left]) if len(left) else True
        return fits, found


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), sizes


def tokenizers(models: tuple[str, bytes]) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one of many on its machine
    key = hash(models)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizers(*models)
    return _loaded[key]


def stretches(text: str) -> list[str]:
    """``text`` cut at single spaces between other characters, which are left out.  Space + text is the same as space +
    stretch for all of them, and neither tokenizer has a token that crosses such a place: A's pattern
    starts a match there, and B's pieces hold the space sign at their front only, or nothing else."""
    return _CUT.split(text) if _OTHER.search(text) else text.split(" ")


class _Aligned:
    """The groups and links of some stretches that are held at once."""

    def __init__(self, by: Tokenizers, texts: list[str]):
        size = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
        found = by.ids_of_stretches(texts, size)
        self.fits, ((a, n_a), (b, n_b)) = by.spells(texts, found, size)
        a, b = a[np.repeat(self.fits, n_a)], b[np.repeat(self.fits, n_b)]
        self.n_a, self.n_b = np.where(self.fits, n_a, 0), np.where(self.fits, n_b, 0)
        a_end, b_end = np.cumsum(by.a_bytes.sizes[a]), np.cumsum(by.b_bytes.sizes[b])
        here = np.zeros((2, int(a_end[-1]) + 1 if len(a) else 1), bool)
        here[0, a_end], here[1, b_end] = True, True
        self.a_last, self.b_last = here[1, a_end], here[0, b_end]  # of their groups
        self.a, self.b = a, b
        self.a_stop, self.b_stop = np.flatnonzero(self.a_last) + 1, np.flatnonzero(self.b_last) + 1
        self.in_a, self.in_b = np.diff(self.a_stop, prepend=0), np.diff(self.b_stop, prepend=0)
        edges = np.append(0, np.cumsum(self.n_a))
        self.n_groups = np.diff(np.searchsorted(self.a_stop, edges, "right"))
        self.group_text = np.repeat(np.arange(len(texts)), self.n_groups)
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, self.group_text, self.in_a * self.in_b)

    def written(self, by: Tokenizers) -> list[bytes]:
        """Per text its groups: decimal ids, A's and B's apart by |, groups by ;"""
        at_a = np.arange(len(self.a)) + np.repeat(self.b_stop - self.in_b, self.in_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.a_stop, self.in_b)
        ids, ends = np.empty(len(at_a) + len(at_b), np.int64), np.empty(len(at_a) + len(at_b), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        ends[at_a], ends[at_b] = np.where(self.a_last, ord("|"), ord(",")), np.where(self.b_last, ord(";"), ord(","))
        text = by.decimal.spelled(ids)
        stops = np.append(0, np.cumsum(by.decimal.sizes[ids]))
        text[stops[1:] - 1] = ends
        flat, edges = text.tobytes(), stops[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        return [flat[s : max(s, e - 1)] for s, e in zip(edges[:-1], edges[1:], strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs' codes, numbers of links, number of pairs per text), text by text."""
        keys, counts, times = [], [], self.in_a * self.in_b
        cuts = np.flatnonzero(np.diff(np.cumsum(times) // LINKS_AT_ONCE)) + 1
        for part in np.split(np.arange(len(times)), cuts):
            if len(part) == 1 and times[part[0]] > LINKS_AT_ONCE:
                found = self._large(int(part[0]))
            else:
                n_a, n_b = self.in_a[part], self.in_b[part]
                a = _ranges(self.a_stop[part] - n_a, n_a)
                by_a = np.repeat(n_b, n_a)  # links of each of these A tokens
                b = _ranges(np.repeat(self.b_stop[part] - n_b, n_a), by_a)
                text = np.repeat(self.group_text[part], n_a * n_b)
                found = np.unique(text << 2 * _BITS | np.repeat(self.a[a], by_a) << _BITS | self.b[b], return_counts=True)
            keys.append(found[0])
            counts.append(found[1])
        keys, counts = added(keys, counts)
        return keys & ((1 << 2 * _BITS) - 1), counts, np.bincount(keys >> 2 * _BITS, minlength=len(self.fits))

    def _large(self, group: int) -> tuple[np.ndarray, np.ndarray]:
        """A single group with very many links: distinct ids first."""
        a, m = np.unique(self.a[self.a_stop[group] - self.in_a[group] : self.a_stop[group]], return_counts=True)
        b, n = np.unique(self.b[self.b_stop[group] - self.in_b[group] : self.b_stop[group]], return_counts=True)
        return (self.group_text[group] << 2 * _BITS | np.repeat(a, len(b)) << _BITS | np.tile(b, len(a))), np.outer(m, n).ravel()


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with its counts added up."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, times = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, times = every[order], times[order]
    heads = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[heads], np.add.reduceat(times, heads) if len(heads) else times


def packed(index: np.ndarray, places: np.ndarray, docs: int) -> dict[str, bytes]:
    """Bitmaps, one for each of the ascending ``index`` numbers: lists of places, or bits."""
    heads = np.flatnonzero(np.append(True, index[1:] != index[:-1])) if len(index) else np.zeros(0, np.int64)
    cards = np.diff(np.append(heads, len(index)))
    dense = cards * _DENSE > docs
    of_dense = np.repeat(dense, cards)
    bits = np.zeros((int(dense.sum()), -(-docs // 8) * 8), bool)
    bits[np.repeat(np.arange(len(bits)), cards[dense]), places[of_dense]] = True
    return {
        "index": index[heads].astype("<u4").tobytes(), "sizes": np.where(dense, 0, cards).astype("<u4").tobytes(),
        "lists": places[~of_dense].astype("<u2").tobytes(), "bits": np.packbits(bits, axis=1).tobytes(),
    }


def _opened(plane: dict[str, bytes], docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index, list sizes, lists, rows of bits) of a plane."""
    return np.frombuffer(plane["index"], "<u4"), np.frombuffer(plane["sizes"], "<u4"), np.frombuffer(plane["lists"], "<u2"), np.frombuffer(plane["bits"], np.uint8).reshape(-1, -(-docs // 8))


def popcounts(plane: dict[str, bytes], docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Index numbers and how many documents each one's bitmap holds."""
    index, sizes, _, bits = _opened(plane, docs)
    counts = sizes.astype(np.int64)
    counts[sizes == 0] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    return index.astype(np.int64), counts


def unpacked(plane: dict[str, bytes], docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(index number, place) of all that the bitmaps hold."""
    index, sizes, lists, bits = _opened(plane, docs)
    row, place = np.nonzero(np.unpackbits(bits, axis=1)[:, :docs])
    return np.concatenate([np.repeat(index, sizes), index[sizes == 0][row]]).astype(np.int64), np.concatenate([lists, place]).astype(np.int64)


class _Block:
    """Documents of which the postings become one row."""

    def __init__(self) -> None:
        self.ids: list = []
        self.known: dict[str, int] = {}  # number of each stretch
        self.docs: list[np.ndarray] = []  # stretches of each document
        self.bytes = 0

    def take(self, doc_ids: list, texts: list[str | None]) -> None:
        known = self.known
        for text in texts:
            self.docs.append(np.array([known.setdefault(s, len(known)) for s in stretches(text)], np.int64) if text else np.zeros(0, np.int64))
            self.bytes += len(text or "")
        self.ids += doc_ids

    def _stretches(self, by: Tokenizers) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch: whether it fits, its four numbers, its groups; and all codes, link counts and pairs per stretch."""
        parts = [(a.fits, np.stack([a.n_a, a.n_b, a.n_groups, a.n_links], axis=1), a.written(by), *a.links()) for a in (_Aligned(by, some) for some in _some(list(self.known)))]
        if not parts:
            return np.zeros(0, bool), np.zeros((0, 4), np.int64), [], *(np.zeros(0, np.int64),) * 3
        fits, numbers, written, codes, counts, sizes = zip(*parts, strict=True)
        return np.concatenate(fits), np.concatenate(numbers), [w for x in written for w in x], *map(np.concatenate, (codes, counts, sizes))

    def row(self, by: Tokenizers, number: int, kind: pa.DataType) -> pa.RecordBatch:
        docs = len(self.ids)
        fits, numbers, written, codes, counts, sizes = self._stretches(by)
        kept = [d if fits[d].all() else d[:0] for d in self.docs]
        groups = [b";".join([written[s] for s in d.tolist()]).decode() for d in kept]
        of = np.repeat(np.arange(docs), [len(d) for d in kept])
        every = np.concatenate([*kept, np.zeros(0, np.int64)])
        sums = np.zeros((docs, 4), np.int64)
        np.add.at(sums, of, numbers[every])
        # A document's stretches with how often it has them, then their pairs.
        held, times = np.unique(of << 32 | every, return_counts=True)
        place, stretch = held >> 32, held & 0xFFFFFFFF
        at = _ranges((np.cumsum(sizes) - sizes)[stretch], sizes[stretch])
        keys, counts = added([codes[at] << 16 | np.repeat(place, sizes[stretch])], [counts[at] * np.repeat(times, sizes[stretch])])
        codes, places = keys >> 16, keys & 0xFFFF
        new = np.append(True, codes[1:] != codes[:-1]) if len(codes) else np.zeros(0, bool)
        index = np.cumsum(new) - 1
        planes = [packed(index, places, docs)]
        in_docs = popcounts(planes[0], docs)[1] if len(codes) else np.zeros(0, np.int64)
        links, more = in_docs.copy(), counts - 1
        while more.any():  # the next bit of what is more than one link
            odd = (more & 1) == 1
            planes.append(packed(index[odd], places[odd], docs))
            which, n = popcounts(planes[-1], docs)
            links[which] += n << (len(planes) - 2)
            more >>= 1
        columns = [
            pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(kind)), *[pa.array([c], pa.list_(pa.int64())) for c in sums.T],
            pa.array([groups], pa.list_(pa.string())), *[pa.array([c], pa.list_(pa.int64())) for c in (codes[new], in_docs, links)],
            pa.array([planes], pa.list_(pa.struct([(n, pa.binary()) for n in ("index", "sizes", "lists", "bits")]))),
        ]
        return pa.record_batch(columns, _NAMES)


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_NAMES = ["block_id", "doc_ids", *_NUMBERS, "groups", "codes", "held", "links", "planes"]


def _some(parts: list[str]) -> Iterator[list[str]]:
    out, size = [], 0
    for p in parts:
        out.append(p)
        size += len(p)
        if size >= SLICE_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


def posting_blocks(docs: DataFrame, models: tuple[str, bytes], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The aligned documents of ``docs`` (doc_id, text) as rows of a block each: arrays doc_ids, n_a, n_b, n_groups,
    n_links and ``groups`` (a text per document: ``a1,a2|b1;a3|b2,b3``), and the block's postings.

    A missing or empty text, or one that the tokens of A or B do not spell as space + text, has no tokens:
    zeros, and no groups.  Rows that share a doc_id, or have none, are documents of their own.  Other columns
    are not looked at.  Blocks follow the partitions of ``docs``: write the result before using it twice, as
    :func:`scored` does.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, number, block = tokenizers(held.value), TaskContext.get().partitionId() << 32, _Block()
        id_type = pa.null()
        for part in (p for b in batches for p in pieces(b, min(SLICE_BYTES, block_bytes))):
            id_type = part["doc_id"].type
            for s in range(0, part.num_rows, BLOCK_DOCS // 2):
                some = part.slice(s, BLOCK_DOCS // 2)
                block.take(some["doc_id"].to_pylist(), some["text"].to_pylist())
                if block.bytes >= block_bytes or len(block.ids) >= BLOCK_DOCS // 2:
                    yield block.row(by, number, id_type)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.row(by, number, id_type)

    numbers = ", ".join(f"{n} array<long>" for n in _NUMBERS)
    made = f"block_id long, doc_ids array<{kind}>, {numbers}, groups array<string>, codes array<long>, held array<long>, links array<long>, planes array<struct<index:binary,sizes:binary,lists:binary,bits:binary>>"
    return docs.select("doc_id", "text").mapInArrow(run, made)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a_id, b_id, code, n_docs, n_links, best): how many documents hold the pair linked, how many links there are
    in all, and whether no other pair of its A id is in more documents."""
    each = blocks.select(F.explode(F.arrays_zip("codes", "held", "links")).alias("_p")).select("_p.*")
    pairs = each.groupBy(F.col("codes").alias("code")).agg(F.sum("held").alias("n_docs"), F.sum("links").alias("n_links"))
    pairs = cut_lineage(pairs.select(F.shiftright("code", _BITS).alias("a_id"), (F.col("code") % (1 << _BITS)).alias("b_id"), "code", "n_docs", "n_links"))
    most = F.broadcast(pairs.groupBy("a_id").agg(F.max("n_docs").alias("_most")))  # a row per id of A's vocabulary at most
    return pairs.join(most, "a_id").select("a_id", "b_id", "code", "n_docs", "n_links", (F.col("n_docs") == F.col("_most")).alias("best"))


def scored(blocks: DataFrame) -> DataFrame:
    """A row per document of :func:`posting_blocks`: doc_id, n_a, n_b, n_groups, n_links, groups, and from the counts of
    all documents n_best (links whose pair no other pair of its A id beats) and count_sum (over links)."""
    kept = cut_lineage(blocks)
    asked = kept.select(F.col("block_id").alias("_of"), F.explode("codes").alias("code"))
    answers = asked.join(pair_counts(kept).select("code", "n_docs", "best"), "code")
    kind = kept.schema["doc_ids"].dataType.elementType.simpleString()
    groups = kept.schema["groups"].dataType.elementType.simpleString()
    sides = kept.drop("codes", "held", "links").groupBy("block_id").cogroup(answers.groupBy("_of"))
    numbers = ", ".join(f"{n} long" for n in _NUMBERS)
    return sides.applyInArrow(_hand_out, f"doc_id {kind}, {numbers}, groups {groups}, n_best long, count_sum long")


def _hand_out(block: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's postings hand the pairs' scores to its documents."""
    order = np.argsort(np.asarray(answers["code"]), kind="stable")
    n_docs, best = np.asarray(answers["n_docs"], np.int64)[order], np.asarray(answers["best"]).astype(np.int64)[order]
    lists = {n: block[n].combine_chunks().flatten() for n in ["doc_ids", *_NUMBERS, "groups"]}
    docs = len(lists["n_a"])
    sums = np.zeros((2, docs), np.int64)
    for k, plane in enumerate(block["planes"][0].as_py()):
        index, place = unpacked(plane, docs)
        for out, score in zip(sums, (best, n_docs), strict=True):
            np.add.at(out, place, score[index] << max(0, k - 1))
    return pa.table([*lists.values(), *map(pa.array, sums)], ["doc_id", *_NUMBERS, "groups", "n_best", "count_sum"])


def align(docs: DataFrame, models: tuple[str, bytes]) -> DataFrame:
    """:func:`scored` of :func:`posting_blocks`."""
    return scored(posting_blocks(docs, models))


def public_models(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[str, bytes]:
    """Models of installed public tokenizers."""
    import public_tokenizers

    return read_models(public_tokenizers.path(a), public_tokenizers.path(b))
