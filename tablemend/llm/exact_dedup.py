"""Exact dedup by distributed MSD radix partitioning.

All documents start in one group.  A round splits every group by the next digit, a run of bytes:
first the length with the opening bytes, then ever longer runs.  A document leaves when its group
has no other member, or when its text has ended, for what still shares its group then is equal to
it byte by byte; no digest takes part.  The digits grow eightfold, so a text of n bytes takes about
log8(n) rounds, and after the first round only documents with company are left.

A group's count and smallest ids are aggregates with map-side combining.  They are written to the
shared folder and then joined back to the rows by a merge join at every size, in a stage of its
own, so that adaptive execution can split a group that holds a third of all rows.  Each round's rows
are written there too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemend.llm.words import normalised
from tablemend.session import cut_lineage

FIRST_DIGIT = 32
GROWTH = 8


def group_equal(docs: DataFrame, first: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are once each run of white space is one space; a missing text counts as
    empty, so empty and missing ones are one group.  The row with the smallest doc_id stays; a
    missing doc_id comes behind all others, and of rows that share text and doc_id one stays.
    ``text_sha256`` is for the reader only.  Other columns of ``docs`` are not looked at.
    """
    body = normalised(F.col("text")).cast("binary")
    rows = docs.select(F.col("doc_id").alias("_doc"), body.alias("_body"))
    rows = rows.select("_doc", "_body", F.length("_body").alias("_n"), F.substring("_body", 1, first).alias("_head"))
    sizes = cut_lineage(rows.groupBy("_n", "_head").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1"))
    met = rows.join(sizes.hint("merge"), ["_n", "_head"], "left").withColumn("_size", F.coalesce("_size", F.lit(1).cast("long"))).select(
        "_doc", F.sha2("_body", 256).alias("_sha"), "_n", "_head", "_size", F.when(F.col("_size") > 1, F.substring("_body", first + 1, 2**31 - 1 - first)).alias("_body")
    )
    met = cut_lineage(met.withColumn("_row", F.monotonically_increasing_id()))
    done = [met.where("_size = 1").select("_doc", F.col("_doc").alias("_keep"), "_size", F.lit(True).alias("_kept"), "_sha")]
    left, within, at, size = met.where("_size > 1").drop("_size"), ["_n", "_head"], first, first * growth
    while True:
        # Start of the text that is left is at byte ``at``; a digit behind its end is empty.
        keyed = left.withColumn("_digit", F.substring("_body", 1, size))
        order = F.struct(F.col("_doc").isNull(), F.col("_doc").alias("doc"), F.col("_row").alias("row"))
        groups = keyed.groupBy(*within, "_digit").agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_first"))
        groups = cut_lineage(groups.select(*within, "_digit", "_size", F.col("_first.doc").alias("_keep"), F.col("_first.row").alias("_group_next")))
        split = keyed.join(groups.hint("merge"), [*within, "_digit"]).select(
            "_doc", "_sha", "_n", "_row", "_size", "_keep", "_group_next", F.substring("_body", size + 1, 2**31 - 1 - size).alias("_body")
        )
        split = cut_lineage(split)
        at += size
        ended = (F.col("_size") == 1) | (F.col("_n") <= at)
        done.append(split.where(ended).select("_doc", "_keep", "_size", (F.col("_row") == F.col("_group_next")).alias("_kept"), "_sha"))
        left = split.where(~ended).select("_doc", "_sha", "_n", "_row", F.col("_group_next").alias("_group"), "_body")
        within, size = ["_n", "_group"], min(size * growth, 1 << 20)
        if left.isEmpty():
            break
    out = reduce(DataFrame.unionByName, done)
    return out.select(
        F.col("_doc").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256")
    )
