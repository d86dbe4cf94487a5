"""N-gram Jaccard join by vertical partitioning.

Documents with the same shingle set form a class, and only one of each class goes on.  The global
n-gram order is by document frequency, then by hash.  It is cut into fragments where the frequency
reaches the next power of two; a pair's overlap is counted fragment by fragment and summed.

What keeps the pairs few, without losing a link:

* Frequencies (``counting``) never come out too low, so an n-gram with frequency one is in no
  other set, and n minus the number of those bounds every overlap of a document.
* Two linked sets share an n-gram among the first n - ceil(0.9 n) + 1 of each in the global order.
* Sets that share such an n-gram are first compared with one of them, the pivot.  Links found so
  far give components, and pairs within one need no look.  For the rest, what two sets share with
  their pivot, and have besides, bounds their overlap.

So a group of near copies costs a multiple of its size, not its square.  The pairs left after all
bounds are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.llm import counting
from tablemend.llm.components import components
from tablemend.llm.words import (
    BASES,
    fingerprints,
    in_blocks,
    n_blocks,
    pieces,
    rolling,
    size_of,
    split_words,
    text_column,
    window_starts,
)
from tablemend.session import cut_lineage

SHINGLE = 3
PERCENT = 90
_MEMBERS = "block_id long, doc_id long, n_shingles long, class binary"
_SETS = "class binary, n long, own long, prefix array<long>, segments array<struct<fragment:int,grams:array<long>>>"
_SETS_ARROW = pa.schema([("class", pa.binary()), ("n", pa.int64()), ("own", pa.int64()), ("prefix", pa.list_(pa.int64())), ("segments", pa.list_(pa.struct([("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])))])


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text behind the other, and the number per text.

    A text with fewer words than ``size`` has its whole sequence as one shingle; one without words has none.
    """
    words, counts = split_words(text_column(texts), lower=True)
    starts = window_starts(counts, size)
    hashes = rolling(fingerprints(words)[0], size, BASES[0])
    hashes = hashes[starts] if len(starts) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)[starts] if len(starts) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        at = np.cumsum(counts) - counts
        whole = [b" ".join(words.slice(at[k], counts[k]).to_pylist()) for k in short]
        extra = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") >> 3 for w in whole]
        hashes, text = np.append(hashes, np.array(extra, np.uint64)), np.append(text, short)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(counts))


def _class(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _split(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []


def needed(n: Column, m: Column, percent: int) -> Column:
    """The smallest overlap with which sets of these sizes link: 100 * overlap >= percent * union."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


class _Chosen:
    """The documents of a block that stand for their class, and their shingles."""

    def __init__(self, block: pa.Table, chosen: pa.Table, size: int):
        wanted = {c: d for c, d in zip(chosen["class"].to_pylist(), chosen["doc_id"].to_pylist(), strict=True)}
        ids = set(wanted.values())
        rows = block.filter(pa.array([d in ids for d in block["doc_id"].to_pylist()], pa.bool_()))
        hashes, counts = shingles(rows["text"], size)
        sets = {_class(s): s for s in _split(hashes, counts) if len(s)}  # equal sets once
        self.classes = sorted(c for c in sets if c in wanted)
        self.sets = [sets[c] for c in self.classes]
        self.all = np.concatenate([*self.sets, np.zeros(0, np.uint64)])


def _sets(chosen: _Chosen, totals: np.ndarray, percent: int) -> pa.Table:
    """Sets that can link at all, in the global order."""
    out, at = [], 0
    for name, grams in zip(chosen.classes, chosen.sets, strict=True):
        n = len(grams)
        often = totals[at : at + n]
        at += n
        own = int((often == 1).sum())
        least = -(-percent * n // 100)
        if n - own < least:
            continue
        order = np.lexsort((grams, often))[own:]
        grams, often = grams[order].astype(np.int64), often[order]
        prefix = grams[: n - least + 1 - own]
        fragment = np.frexp(often)[1]  # one more for each doubling
        cuts = np.flatnonzero(np.diff(fragment)) + 1
        heads = fragment[np.concatenate([[0], cuts])] if len(grams) else []
        segments = [{"fragment": int(f), "grams": g} for f, g in zip(heads, np.split(grams, cuts), strict=len(grams) > 0)]
        out.append({"class": name, "n": n, "own": own, "prefix": prefix, "segments": segments})
    return pa.Table.from_pylist(out, schema=_SETS_ARROW)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of classes with ``shared``: partial overlaps by fragment, summed."""
    segments = sets.select("class", F.explode("segments").alias("s")).select("class", "s.fragment", "s.grams")
    left = pairs.select("a", "b").join(segments.select(F.col("class").alias("a"), "fragment", F.col("grams").alias("_a")), "a")
    met = left.join(segments.select(F.col("class").alias("b"), "fragment", F.col("grams").alias("_b")), ["b", "fragment"])
    partial = met.select("a", "b", F.size(F.array_intersect("_a", "_b")).cast("long").alias("shared"))
    return partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def linked_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes: all that their components need."""
    sizes = sets.select("class", "n", "own")
    lists = cut_lineage(sets.select(F.explode("prefix").alias("gram"), "class", "n", "own"))
    pivots = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("_k"), F.min(F.struct(F.col("own") / F.col("n"), "class", "n", "own")).alias("p")).where("_k > 1")
    # Written first: a join whose own stage also aggregates could not split a long list.
    pivots = cut_lineage(pivots.select("gram", F.col("p.class").alias("pivot"), F.col("p.n").alias("p_n"), F.col("p.own").alias("p_own")))
    met = lists.join(pivots, "gram")
    can = needed(F.col("n"), F.col("p_n"), percent) <= F.least(F.col("n") - F.col("own"), F.col("p_n") - F.col("p_own"))
    star = cut_lineage(met.where((F.col("class") != F.col("pivot")) & can).select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct())
    counted = cut_lineage(_with_sizes(overlaps(star, sets), sizes))
    first = counted.where(F.col("shared") >= needed(F.col("a_n"), F.col("b_n"), percent)).select("a", "b")
    known = components(first)
    shared = counted.select(F.col("a").alias("pivot"), F.col("b").alias("class"), "shared")
    rest = met.where(F.col("class") != F.col("pivot")).join(known.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    open_lists = cut_lineage(rest.groupBy("gram").agg((F.min("label") != F.max("label")).alias("_open")).where("_open").select("gram"))
    rest = cut_lineage(rest.join(open_lists, "gram").join(shared, ["pivot", "class"], "left").select("gram", "class", "label", "n", "own", "shared"))
    x = rest.select("gram", *[F.col(c).alias(f"x_{c}") for c in rest.columns if c != "gram"])
    y = rest.select("gram", *[F.col(c).alias(f"y_{c}") for c in rest.columns if c != "gram"])
    plain = F.least(F.col("x_n") - F.col("x_own"), F.col("y_n") - F.col("y_own"))
    by_pivot = F.least("x_shared", "y_shared") + F.least(F.col("x_n") - F.col("x_own") - F.col("x_shared"), F.col("y_n") - F.col("y_own") - F.col("y_shared"))
    most = F.least(plain, F.coalesce(by_pivot, plain))
    pairs = x.join(y, (x["gram"] == y["gram"]) & (F.col("x_class") < F.col("y_class")) & (F.col("x_label") != F.col("y_label")) & (needed(F.col("x_n"), F.col("y_n"), percent) <= most))
    pairs = cut_lineage(pairs.select(F.col("x_class").alias("a"), F.col("y_class").alias("b")).distinct())
    more = _with_sizes(overlaps(pairs, sets), sizes).where(F.col("shared") >= needed(F.col("a_n"), F.col("b_n"), percent)).select("a", "b")
    return cut_lineage(first.union(more))


def _with_sizes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("class").alias(side), F.col("n").alias(f"{side}_n")), side)
    return pairs


def join_similar(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two rows link when 100 * overlap >= percent * union of their distinct ``size``-word shingles
    (A-Z in lower case).  ``component_id`` is the smallest doc_id that links reach; a row without
    words links with nothing and has its own.  Rows with equal sets are linked.  A missing doc_id
    counts as larger than any other and is a component's id only if it has no other.  Repeated rows
    are repeated in the result.  Other columns of ``docs`` are not looked at.
    """
    total_bytes, _ = size_of(docs)
    blocks = in_blocks(docs, n_blocks(docs, total_bytes))
    buckets = counting.n_buckets(docs, total_bytes // 5)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole)):
            hashes, counts = shingles(b["text"], size)
            names = [_class(s) for s in _split(hashes, counts)]
            yield pa.record_batch([b["block_id"], b["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(names, pa.binary())], ["block_id", "doc_id", "n_shingles", "class"])

    def first_round(block: pa.Table, chosen: pa.Table) -> pa.Table:
        if not len(block) or not len(chosen):
            return counting.keys_table([])
        return counting.Coded(_Chosen(block, chosen, size).all, buckets).table(block["block_id"][0].as_py())

    def second_round(block: pa.Table, given: pa.Table) -> pa.Table:
        if not len(block) or not len(given):
            return _SETS_ARROW.empty_table()
        is_answer = pa.compute.is_valid(given["bucket"])
        answers, chosen = given.filter(is_answer), given.filter(pa.compute.invert(is_answer))
        own = _Chosen(block, chosen.rename_columns({"totals": "class"}), size)
        totals = counting.Coded(own.all, buckets).totals(answers["bucket"].to_pylist(), answers["totals"].to_pylist())
        return _sets(own, totals, percent)

    members = cut_lineage(blocks.mapInArrow(classify, _MEMBERS))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc"), F.col("block_id").alias("block"))).alias("f")
    chosen = members.where("n_shingles > 0").groupBy("class").agg(first).select("class", F.col("f.doc").alias("doc_id"), F.col("f.block").alias("block_id"))
    chosen = cut_lineage(chosen)
    docs_by_block = blocks.groupBy("block_id")
    keys = docs_by_block.cogroup(chosen.groupBy("block_id")).applyInArrow(first_round, counting.KEYS)
    answers = counting.add_up(keys).select("block_id", "bucket", "totals", F.lit(None).cast("long").alias("doc_id"))
    given = answers.union(chosen.select("block_id", F.lit(None).cast("int").alias("bucket"), F.col("class").alias("totals"), "doc_id"))
    sets = cut_lineage(docs_by_block.cogroup(given.groupBy("block_id")).applyInArrow(second_round, _SETS))
    found = components(linked_pairs(sets, percent))
    labelled = chosen.select("class", "doc_id").join(found.withColumnRenamed("node", "class"), "class", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "class"))
    smallest = cut_lineage(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    by_class = labelled.join(smallest, "label").select(F.col("class").alias("_class"), F.col("component_id").alias("_component"))
    out = members.join(by_class, F.col("class") == F.col("_class"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("_component")).alias("component_id"))
