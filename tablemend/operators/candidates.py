"""Candidate generation by equi-join only.

Pairs are formed between *distinct* values or value tuples, never between raw rows,
and a pair is emitted only if it shares a key that every acceptable pair must share.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions.editdist import deletion_keys, edit_distance
from tablemend.functions.expr import ascii_lower
from tablemend.session import is_small


def _null_safe(left: str, right: str, on: Sequence[str]):
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def blocked(records: DataFrame, entities: DataFrame, on: Sequence[str]) -> DataFrame:
    """Entities sharing the record's guaranteed keys (missing matches missing).

    Pass distinct value tuples as records: copies of one tuple then cost one lookup.
    """
    extra = [F.col(f"e.{c}") for c in entities.columns if c not in on]
    return records.alias("r").join(entities.alias("e"), _null_safe("r", "e", on)).select("r.*", *extra)


COUNTED = [*"0123456789", *"aeinorst", "dhlu", "bcgmpw", "fjkqvxyz"]  # letters counted together, up to 3


def letters_of(text: Column | str) -> Column:
    """How often each group of letters of ``COUNTED`` occurs, as 3 bits a group: one set for each occurrence up to the
    third.  An edit moves at most one letter out of a group and one into another, and a swap none."""
    lower = ascii_lower(text)
    out = F.lit(0).cast("long")
    for i, group in enumerate(COUNTED):
        n = F.least(F.length(lower) - F.length(F.translate(lower, group, "")), F.lit(3))
        out = out.bitwiseOR(F.element_at(F.array(*[F.lit(((1 << k) - 1) << 3 * i).cast("long") for k in range(4)]), n + 1))
    return out


def within_bound(pairs: DataFrame, observed: str, word: str, max_typos: int, name: str = "k") -> DataFrame:
    """Keep pairs at edit distance <= max_typos.  Plain Levenshtein, at most twice the
    distance with swaps, discards most pairs inside the JVM."""
    close = pairs.where(F.levenshtein(F.col(observed), F.col(word), 2 * max_typos) >= 0)
    return close.withColumn(name, edit_distance(observed, word, max_typos)).where(F.col(name) <= max_typos)


def _by_letters(met: DataFrame, on: Sequence[str], max_typos: int) -> DataFrame:
    """(on, observed, word, k): the pairs within the bound of those that meet, whose :func:`letters_of` are _lo and _lw.

    A distance of k with s swaps is at most k + s in plain edits and changes at most 2 * (k - s) letters, so letters
    discard most pairs before they are compared.  What is left is made distinct before it is looked at closely.
    """
    changed = F.bit_count(F.col("_lo").bitwiseXOR(F.col("_lw")))
    # Too far apart is -1, here a large number: the distance is named once, as it is computed wherever it is named.
    plain = F.levenshtein(F.col("observed"), F.col("word"), 2 * max_typos).bitwiseAND(0x3FFFFFFF)
    close = met.where(changed <= 2 * max_typos).where(plain * 2 <= 4 * max_typos - changed).select(*on, "observed", "word", changed.alias("_changed"))
    # Few bytes take long to compare, so partitions are not to be merged by their bytes.
    close = close.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, "observed", "word").distinct()
    if max_typos > 2:
        return within_bound(close, "observed", "word", max_typos).drop("_changed")
    k = edit_distance("observed", "word", max_typos, "_changed")
    return close.select(*on, "observed", "word", F.explode(F.filter(F.array(k), lambda x: x <= max_typos)).alias("k"))


FEW_WORDS = 1000  # list at most a few hundred thousand keys, at most two typos apart


def few(observed: DataFrame, words: DataFrame, max_typos: int) -> str | None:
    """The side, of "words" and "observed", that is measured to hold so few texts that its keys may be broadcast."""
    for side, texts in (("words", words), ("observed", observed)) if max_typos <= 2 else ():
        if is_small(texts.distinct(), FEW_WORDS, 1 << 20):
            return side
    return None


def _met(observed: DataFrame, words: DataFrame, keys: Sequence[str], on: Sequence[str], max_typos: int, small: str | None = None) -> DataFrame:
    """(on, observed, word, k): pairs within the bound of two tables of keys that share one of ``keys``.

    Tables of keys are many times as large as the words that Spark knows the size of, so it is told not to
    broadcast them, but for those of a ``small`` side.
    """
    if small == "observed":
        observed = observed.hint("broadcast")
    else:
        words = words.hint("broadcast" if small else "merge")
    met = observed.join(words, [*keys])
    if {"_lo", "_lw"} <= set(met.columns):
        return _by_letters(met, on, max_typos)
    met = met.select(*on, "observed", "word")
    # Letters decide: equal hashes alone prove nothing.  Where the JVM can tell, they do so before the pairs are made
    # distinct, as most that meet are too far apart; what costs a call of Python is done once per pair.
    if max_typos <= 2:
        return within_bound(met, "observed", "word", max_typos).distinct()
    return within_bound(met.distinct(), "observed", "word", max_typos)


def by_deletion(observed: DataFrame, words: DataFrame, max_typos: int, on: Sequence[str] = (), small: str | None = None) -> DataFrame:
    """All (observed, word) pairs within ``max_typos`` edits, found without pairing everything.  ``small`` as in :func:`few`.

    Both sides list what is left after dropping up to ``max_typos`` letters; pairs within
    the bound always meet in one such string, and pairs that meet are never more than
    twice as far apart, so the join's size follows the size of the result.  A word lists
    about length**max_typos strings: for long words use ``by_segments``.
    """

    # Few bytes become many keys and pairs, so partitions are not to be merged by their bytes.
    partitions = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(words_: DataFrame, word: str) -> DataFrame:
        listed = words_.select(*on, word).where(F.col(word).isNotNull()).repartition(partitions, *on, word).distinct()
        out = listed.select(*on, word, F.inline(deletion_keys(word, max_typos))).select(*on, word, F.col("v").alias("_v"))
        return out if small else out.repartition(partitions, *on, "_v")

    return _met(keyed(observed, "observed"), keyed(words, "word"), [*on, "_v"], on, max_typos, small)


# Up to this length, listing a word's deletions costs no more than listing its segments.
SHORT_WORD = 20
SEGMENT = 6  # letters of a segment, where that makes at most MORE_SEGMENTS more than the bound needs
MORE_SEGMENTS = 8


def _segment_keys(max_typos: int, moved: bool):
    """The keys of a text's segments, or with ``moved`` those of all words that may lie within the bound of it."""
    least, letters, longest = max_typos + 1, SEGMENT, SHORT_WORD
    most = least + MORE_SEGMENTS

    # In Python, which lists a text's keys many times as fast as nested array functions do.  Defined inside a function so
    # that Spark ships the code itself to the executors.
    def listed(texts: pd.Series) -> pd.Series:
        cuts: dict[int, list[tuple[int, int, int]]] = {}
        near = range(-max_typos, max_typos + 1) if moved else (0,)
        moves = [(more, shift, left) for more in near for shift in near if (left := max_typos - abs(shift) - abs(more + shift)) >= 0]

        def cut(length: int) -> list[tuple[int, int, int]]:
            """The segments of a word of this length: a mark of both, the first place and that behind the last."""
            if length not in cuts:
                parts = min(max(length // letters, least), most)
                ends = [length * i // parts for i in range(parts + 1)]
                cuts[length] = [((length & 0x7FFFFF) << 40 | i << 32, ends[i], ends[i + 1]) for i in range(parts)]
            return cuts[length]

        def keys(raw: bytes) -> list[int]:
            text, out = raw.decode("utf-8", "surrogateescape"), set()
            size = len(text)
            for more, shift, left in moves:
                for mark, start, end in cut(size + more) if size + more > longest else ():
                    start, end = start + shift, end + shift
                    if start < 0 or end > size:
                        continue
                    ways = [text[start:end]]
                    if moved and left >= 1:
                        before, behind = text[max(start - 1, 0) : start], text[end : end + 1]
                        if before:
                            ways.append(before + text[start + 1 : end])
                        if behind:
                            ways.append(text[start : end - 1] + behind)
                        if before and behind and left >= 2:
                            ways.append(before + text[start + 1 : end - 1] + behind)
                    out.update(mark | zlib.crc32(w.encode("utf-8", "surrogateescape")) for w in ways)
            return list(out)

        return texts.map(keys, na_action="ignore")

    return F.pandas_udf(listed, "array<bigint>")


def by_segments(observed: DataFrame, words: DataFrame, max_typos: int, on: Sequence[str] = (), small: str | None = None) -> DataFrame:
    """All (observed, word) pairs within ``max_typos`` edits, whatever their lengths.  ``small`` as in :func:`few`.

    A word longer than ``SHORT_WORD`` is cut into max_typos + 1 segments or, as it is longer, up to
    ``MORE_SEGMENTS`` more.  An edit touches one of them, but for a swap across a cut, which the observed text lists undone:
    with the letter before or behind a place in that of its first or last one.  So all but max_typos segments stand
    unchanged among what the observed text lists, and of any max_typos + 1 at least one.  A word is found under those of its
    segments that the fewest words have, so that what many have in common (``https://``) brings few pairs
    together.  A segment is moved by the edits before it, and those behind it make up the rest of the difference in
    length; both and the swaps undone are at most ``max_typos``.  An observed text lists (length of the word, number of the
    segment, its letters), hashed, for every such place: a number of keys that does not grow with its length.  Shorter words
    go through ``by_deletion``.
    """
    obs = observed.select(*on, "observed").where(F.col("observed").isNotNull())
    wrd = words.select(*on, "word").where(F.col("word").isNotNull())
    short = by_deletion(obs.where(F.length("observed") <= SHORT_WORD + max_typos), wrd.where(F.length("word") <= SHORT_WORD), max_typos, on, small)
    least = max_typos + 1
    # Few bytes become many keys and pairs, so partitions are not to be merged by their bytes.
    partitions = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    keys = [*on, "_v"]
    long = wrd.where(F.length("word") > SHORT_WORD).withColumn("_lw", letters_of("word")).repartition(partitions, *on, "word").distinct()
    listed = long.select(*on, "word", "_lw", F.explode(_segment_keys(max_typos, False)(F.col("word").cast("binary"))).alias("_v"))
    shared = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_words"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.`{k}`").eqNullSafe(F.col(f"s.`{k}`"))
    counted = listed.alias("l").join(shared.alias("s").hint("merge"), same).select("l.*", "s._words")
    ranked = counted.groupBy(*on, "word", "_lw").agg(F.slice(F.array_sort(F.collect_list(F.struct("_words", "_v"))), 1, least).alias("_own"))
    own = ranked.select(*on, "word", "_lw", F.explode(F.transform("_own", lambda x: x["_v"])).alias("_v"))

    near = obs.where(F.length("observed") > SHORT_WORD - max_typos).withColumn("_lo", letters_of("observed")).repartition(partitions, *on, "observed").distinct()
    theirs = near.select(*on, "observed", "_lo", F.explode(_segment_keys(max_typos, True)(F.col("observed").cast("binary"))).alias("_v"))
    if not small:
        own, theirs = own.repartition(partitions, *keys), theirs.repartition(partitions, *keys)
    return short.unionByName(_met(theirs, own, keys, on, max_typos, small).select(*short.columns))


def _segments(text: str, length: Column, shift: Column, max_typos: int) -> Column:
    """The segments of a word of this length as they stand in ``text``, moved by ``shift``, each hashed with
    that length and its number."""
    parts = 2 * max_typos + 1
    start = lambda i: F.floor(length * i / parts).cast("int") + 1
    at = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("i"), (start(i) + shift).alias("at"), (start(i + 1) - start(i)).alias("n"))
    )
    inside = F.filter(at, lambda x: x["at"] >= 1)
    return F.transform(inside, lambda x: F.xxhash64(length, x["i"], F.substr(F.col(text), x["at"], x["n"])))


def _listed(words: DataFrame, word: str, on: Sequence[str], short: Column, long: Column) -> DataFrame:
    distinct = words.select(*on, word).where(F.col(word).isNotNull()).distinct()
    return distinct.select(*on, word, F.explode(F.array_distinct(F.concat(short, long))).alias("_v"))


def _deletions(word: str, max_typos: int, up_to: int) -> Column:
    none = F.array().cast("array<bigint>")
    return F.when(F.length(word) <= up_to, F.transform(deletion_keys(word, max_typos), lambda x: x["v"])).otherwise(none)


def word_keys(words: DataFrame, max_typos: int, on: Sequence[str] = ()) -> DataFrame:
    """(on, word, _v): the keys under which a word is found, whatever its length.  They depend on the word alone, so they
    may be stored and added to as words come in."""
    none = F.array().cast("array<bigint>")
    long = F.when(F.length("word") > SHORT_WORD, _segments("word", F.length("word"), F.lit(0), max_typos)).otherwise(none)
    return _listed(words, "word", on, _deletions("word", max_typos, SHORT_WORD), long)


def observed_keys(observed: DataFrame, max_typos: int, on: Sequence[str] = ()) -> DataFrame:
    """(on, observed, _v): the keys of all words that may lie within the bound.  Every such word has one of them."""
    none, near = F.array().cast("array<bigint>"), F.sequence(F.lit(-max_typos), F.lit(max_typos))
    size = F.length("observed")
    lengths = F.filter(F.transform(near, lambda more: size + more), lambda n: n > SHORT_WORD)
    moved = F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(near, lambda shift: _segments("observed", n, shift, max_typos)))))
    long = F.when(size > SHORT_WORD - max_typos, moved).otherwise(none)
    return _listed(observed, "observed", on, _deletions("observed", max_typos, SHORT_WORD + max_typos), long)


def meet(observed: DataFrame, words: DataFrame, max_typos: int, on: Sequence[str] = ()) -> DataFrame:
    """(on, observed, word, k): the pairs within the bound of two tables of keys."""
    return _met(observed, words, [*on, "_v"], on, max_typos)


def constrained(candidates: DataFrame, conditions) -> DataFrame:
    """Drop candidates that contradict a field observed without error."""
    for c in conditions:
        candidates = candidates.where(c)
    return candidates
