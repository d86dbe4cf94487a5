"""The corpus pipeline: five stages, each over all that the one before kept.

``run`` applies them to ``documents``.  Every stage takes (spark, docs, sf_dir) and all but the last
return the columns of ``docs``.  A document is a row: rows that share a doc_id, or have none, are
judged one by one.  Of copies the smallest doc_id stays, a missing one only if there is no other, and of
rows with the same doc_id one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.llm import bpe, language_id, mixing, ngram_join
from tablemend.llm.exact_dedup import group_equal
from tablemend.llm.queries import EPOCHS, SEED, SHARE, TREE
from tablemend.session import cut_lineage, scratch, scratch_path

MIN_HIT_SHARE = 0.1  # of a text's n-grams that its language must contain


def _order() -> Column:
    """Which of copies stays: the first in this order."""
    return F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id"), F.col("_row"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``_row`` for each row.  A stage's ``docs`` are a written table, and every scan of one
    table in one session deals the same rows to the same partitions in the same order, so all readers see the
    same numbers without a numbered copy of all texts."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Numbered ``docs`` without the rows in ``gone`` (_row), and without the numbers.  The list of
    those is written first, so that the planner knows its size when it picks the join."""
    return docs.join(cut_lineage(gone.select(F.col("_row").alias("_gone"))), F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose n-grams are of no learned language."""
    rows = _numbered(docs)
    found = language_id.identify(rows.select(F.col("_row").alias("doc_id"), "text"), language_id.learn(docs))
    good = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("hit_share") >= MIN_HIT_SHARE)
    return _without(rows, found.where(~good).select(F.col("doc_id").alias("_row")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    rows = _numbered(docs)
    found = group_equal(rows.select(_order().alias("doc_id"), "text"))
    return _without(rows, found.where("not kept").select("doc_id._row"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (3-word shingles, 0.9) the row with the smallest doc_id stays."""
    rows = _numbered(docs)
    found = ngram_join.join_similar(rows.select(F.col("_row").alias("doc_id"), "text"))
    found = cut_lineage(found.select(F.col("doc_id").alias("_row"), "component_id").where("_row <> component_id"))
    # Rows that are not alone: those found, and their components' first rows.
    members = found.union(found.select(F.col("component_id").alias("_row"), "component_id").distinct())
    members = cut_lineage(members.join(rows.select("_row", "doc_id"), "_row").select("_row", "component_id", _order().alias("_order")))
    stays = members.groupBy("component_id").agg(F.min("_order").alias("_first")).select(F.col("_first._row").alias("_row"))
    return _without(rows, members.join(stays, "_row", "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to target weights; what is taken in several epochs comes as often."""
    return mixing.mixed_documents(docs, TREE, SHARE, EPOCHS, SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of each document, and a digest of what they decode to."""
    ranks, pattern = bpe.vocabulary(spark)
    return bpe.there_and_back(docs, ranks, pattern).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", tokens),
]

ORACLE_SQL = None  # language ID is learned and the BPE ids need the library


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark)
        with scratch(spark):  # what a stage wrote for itself goes once its rows are committed
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
