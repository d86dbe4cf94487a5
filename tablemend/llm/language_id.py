"""Language identification with n-gram filters that answer with a set of languages.

A bit-sliced Bloom filter has one bit per language in each slot.  Looking an n-gram up combines its
slots with AND and returns at once all languages that contain it; a text's n-grams, counted per
language bit and corrected for each language's share of false positives, decide.

A language contains an n-gram if it is at least ``MIN_SHARE`` of the language's n-grams, however much
more frequent the n-gram is in another one.  At most 1 / MIN_SHARE n-grams can reach that share, which
bounds the filter whatever the corpus: it is the only thing broadcast.  The counts behind the shares
are over all labelled texts that are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.llm.words import pieces, split_words, text_column
from tablemend.session import cut_lineage

MIN_SHARE = 1e-5
BITS_PER_GRAM = 16
UNKNOWN = "und"
_HELD = 4_000_000  # counted n-grams a task holds before it sends them on
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def held_out() -> Column:
    """Documents never learned from; those without id are learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """3- and 4-byte n-grams of words set in spaces, as codes, and the word each is from."""
    n = len(words)
    at = np.frombuffer(words.buffers()[1], np.int64)[: n + 1] + np.arange(n + 1)
    stream = np.full(int(at[-1]) + 3, 32, np.uint32)  # each word behind one space, spaces at the end
    letters = np.ones(int(at[-1]), bool)
    letters[at[:-1]] = False
    body = words.buffers()[2]
    stream[: len(letters)][letters] = np.frombuffer(body, np.uint8)[: int(at[-1]) - n] if body is not None else 0
    word = np.repeat(np.arange(n), np.diff(at))
    m = len(word)
    a, b, c, d = (stream[k : k + m] for k in range(4))
    three = b != 32
    four = three & (c != 32)
    codes = np.concatenate([((a << 24) | (b << 16) | (c << 8))[three], ((a << 24) | (b << 16) | (c << 8) | d)[four]])
    return codes.astype(np.uint32), np.concatenate([word[three], word[four]])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words, the word at each place, and the text of each place."""
    words, counts = split_words(text_column(pc.utf8_lower(texts.cast(pa.large_string()))))
    coded = words.dictionary_encode()
    own = pa.array(coded.dictionary.to_pylist(), pa.large_binary())
    return own, np.asarray(coded.indices, np.int64), np.repeat(np.arange(len(texts)), counts)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            found, place = np.unique(codes, return_inverse=True)
            return found, np.bincount(place, weights=n).astype(np.int64)

        def send():
            for lang, parts in held.items():
                codes, n = merged(parts)
                yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for b in (p for whole in batches for p in pieces(whole)):
            own, place, text = _words(b["text"])
            if not len(own):
                continue
            codes, of_word = _grams(own)
            names = pc.dictionary_encode(b["lang"])
            by_text = np.asarray(names.indices, np.int64)
            for k, lang in enumerate(names.dictionary.to_pylist()):
                times = np.bincount(place[by_text[text] == k], minlength=len(own))
                used = times[of_word] > 0
                held.setdefault(lang, []).append((codes[used], times[of_word][used]))
                held[lang] = [merged(held[lang])]
            if sum(len(p[0][0]) for p in held.values()) > _HELD:
                yield from send()
        yield from send()

    counted = labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """One filter for all languages: ``slots`` has a row of language bits per slot."""

    def __init__(self, languages: list[str], grams: np.ndarray, masks: np.ndarray, bits_per_gram: int = BITS_PER_GRAM):
        """``masks``: for each n-gram, one boolean per language."""
        self.languages = languages
        self.shift = np.uint64(64 - max(10, int(np.ceil(np.log2(max(1, len(grams)) * bits_per_gram)))))
        bits = np.zeros((1 << (64 - int(self.shift)), len(languages)), bool)
        for slot in self._slots(grams):
            for k in range(len(languages)):
                bits[slot[masks[:, k]], k] = True
        self.false_hits = bits.mean(axis=0) ** len(_ODD)
        self.slots = np.packbits(bits, axis=1, bitorder="little")

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64)[None, :] + np.uint64(1)) * _ODD[:, None]) >> self.shift

    def containing(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram, one boolean per language."""
        found = np.bitwise_and.reduce(self.slots[self._slots(codes)], axis=0)
        return np.unpackbits(found, axis=1, bitorder="little", count=len(self.languages))

    def shares(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages): the share of a text's n-grams that each language contains, corrected."""
        own, place, text = _words(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(own):
            return out
        codes, of_word = _grams(own)
        found = self.containing(codes)
        per_word = np.bincount(of_word, minlength=len(own))
        total = np.maximum(np.bincount(text, weights=per_word[place], minlength=len(texts)), 1)
        for k, false in enumerate(self.false_hits):
            hits = np.bincount(of_word, weights=found[:, k], minlength=len(own))
            hits = np.bincount(text, weights=hits[place], minlength=len(texts))
            out[:, k] = np.clip((hits - total * false) / (1 - false if false < 1 else 1), 0, None) / total
        return out


def learn(docs: DataFrame, min_share: float = MIN_SHARE) -> Filters:
    """Filters from the labelled rows that are not held out."""
    counts = cut_lineage(count_grams(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= min_share)
    rows = shares.select("lang", "gram").toArrow()
    languages = sorted(r["lang"] for r in totals.select("lang").collect())  # one row per language
    grams, place = np.unique(np.asarray(rows["gram"], np.int64), return_inverse=True)
    masks = np.zeros((len(grams), len(languages)), bool)
    if len(grams):
        masks[place, np.searchsorted(languages, rows["lang"].to_pylist())] = True
    return Filters(languages, grams, masks)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score, hit_share.

    ``score`` is the winner's part of all languages' shares, ``hit_share`` the part of the text's
    n-grams that the winner contains.  Equal shares go to the language first in the alphabet.  A
    missing text, one without a letter, and any text if no language was learned, is ``und`` with
    score 0.  Other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = held.value
        for b in (p for whole in batches for p in pieces(whole)):
            known = np.asarray(b["known"].to_numpy(zero_copy_only=False), bool)
            shares = by.shares(b["text"])
            if by.languages:
                best = shares.argmax(axis=1)
                hit = np.where(known, shares.max(axis=1), 0.0)
                score = np.divide(hit, shares.sum(axis=1), out=np.zeros(len(hit)), where=hit > 0)
                names = [by.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            else:
                hit = score = np.zeros(b.num_rows)
                names = [UNKNOWN] * b.num_rows
            yield pa.record_batch([b["doc_id"], b["held_out"], pa.array(names, pa.string()), pa.array(score), pa.array(hit)], ["doc_id", "held_out", "lang_pred", "score", "hit_share"])

    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), known.alias("known"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, hit_share double")
