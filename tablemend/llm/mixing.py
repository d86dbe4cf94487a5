"""Mixing sources to target weights by hierarchical budgeting.

Sources are the leaves of a tree (domain, language, source).  A token budget runs down the tree:
at each node it is divided by the children's weights, a child that cannot use its part gets what it
can use, and the rest goes to its siblings by their weights.  As a child can use what its whole
subtree can, a shortage is made up among siblings first, and moves to the ancestors' siblings only
if they cannot make it up.  All of it is integer arithmetic in windows over the node table.

A leaf offers each document once per epoch; each epoch has its own order, by a hash of seed, epoch
and doc_id.  A leaf takes the prefix of that stream that holds its budget, the last document in
part.  Where the prefix ends is found by bucket: tokens are summed per leaf, epoch and opening
digits of the hash, the bucket in which the budget runs out is known from running totals, and only
that bucket's rows are ordered.  So no leaf is ever sorted whole, however large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.llm.words import word_pattern
from tablemend.session import cut_lineage

BUCKET_DIGITS = 4  # 65,536 buckets for each leaf and epoch
_ALL = "~"  # behind every hash


@dataclass(frozen=True)
class Tree:
    """Levels from the root down: a name, the SQL expression that gives a document's node, and the nodes'
    integer weights; nodes not named have weight ``other``.  Weights below 1 are not allowed."""

    levels: Sequence[tuple[str, str]]
    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    other: int = 1

    def weight(self, level: str) -> Column:
        named = self.weights.get(level, {})
        if min([self.other, *named.values()]) < 1:
            raise ValueError("weights are integers from 1")
        out = F.lit(self.other)
        for node, w in named.items():
            out = F.when(F.col(f"_{level}") == node, F.lit(w)).otherwise(out)
        return out.cast("decimal(20,0)")

    @property
    def names(self) -> list[str]:
        return [f"_{name}" for name, _ in self.levels]


def _key(epoch: Column, seed: int) -> Column:
    """The place of a document in the order of an epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _n_tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(word_pattern())), F.lit(0)).cast("long").alias("n_tokens")


def _leaves(docs: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, the node at each level (a missing value is a node of its own, named ``""``) and n_tokens."""
    nodes = [F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(f"_{name}") for name, c in tree.levels]
    return docs.select("doc_id", *nodes, _n_tokens())


def divide(nodes: DataFrame, parent: Sequence[str], node: str) -> DataFrame:
    """``nodes`` (parent columns, node, weight, can, given) with ``got``: the node's part of what is
    ``given`` to its parent, where no node gets more than it ``can`` use."""
    by = [F.col(c) for c in parent] or [F.lit(0)]
    ratio, name = F.col("can") / F.col("weight"), F.col(node)
    earlier = Window.partitionBy(*by).orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(ratio, name).rowsBetween(0, Window.unboundedFollowing)
    out = nodes.withColumn("_before", F.coalesce(F.sum("can").over(earlier), F.lit(0)).cast("decimal(20,0)"))
    out = out.withColumn("_weights", F.sum("weight").over(later).cast("decimal(20,0)"))
    out = out.withColumn("_full", F.col("can") * F.col("_weights") <= (F.col("given") - F.col("_before")) * F.col("weight"))
    every = Window.partitionBy(*by)
    out = out.withColumn("_rest", (F.col("given") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("can"))).over(every), F.lit(0))).cast("decimal(20,0)"))
    share = F.when(~F.col("_full"), F.col("weight"))
    out = out.withColumn("_open", F.coalesce(F.sum(share).over(every), F.lit(1)).cast("decimal(18,0)"))
    upto = Window.partitionBy(*by).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_upto", F.coalesce(F.sum(share).over(upto), F.lit(0)).cast("decimal(18,0)"))
    part = F.expr("(_rest * _upto) div _open - (_rest * (_upto - weight)) div _open")
    out = out.withColumn("got", F.when(F.col("_full"), F.col("can")).otherwise(part).cast("decimal(20,0)"))
    return out.drop("_before", "_weights", "_full", "_rest", "_open", "_upto")


def budgets(leaves: DataFrame, tree: Tree, share: float, epochs: int) -> DataFrame:
    """Per leaf: supply (its tokens) and budget, for a total of ``share`` of all tokens, or of what
    all leaves can give in ``epochs`` if that is less."""
    supply = cut_lineage(leaves.groupBy(*tree.names).agg(F.sum("n_tokens").alias("supply")))
    given = supply.agg(F.least(F.floor(F.sum("supply") * F.lit(share)), F.sum("supply") * epochs).cast("decimal(20,0)").alias("given"))
    parents: list[str] = []
    above = given
    for name, _ in tree.levels:
        node = f"_{name}"
        below = supply.groupBy(*parents, node).agg((F.sum("supply") * epochs).cast("decimal(20,0)").alias("can")).withColumn("weight", tree.weight(name))
        below = below.join(above, parents) if parents else below.crossJoin(F.broadcast(above))  # one row
        parents = [*parents, node]
        above = divide(below, parents[:-1], node).select(*parents, F.col("got").alias("given"))
    return supply.join(above.withColumn("budget", F.col("given").cast("long")).drop("given"), tree.names)


def cuts(leaves: DataFrame, budget: DataFrame, tree: Tree, epochs: int, seed: int) -> DataFrame:
    """Per leaf and epoch that gives anything: ``last``, the hash of the last document taken, and
    ``taken``, how many of that document's tokens are (null if the whole epoch is taken)."""
    names = tree.names
    turn = F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")
    wanted = budget.select(*names, "supply", "budget", turn)
    wanted = wanted.withColumn("want", F.least("supply", F.col("budget") - (F.col("epoch") - 1) * F.col("supply"))).where("want > 0")
    wanted = cut_lineage(wanted.select(*names, "epoch", "supply", "want"))
    whole = wanted.where("want = supply").select(*names, "epoch", F.lit(_ALL).alias("last"), F.lit(None).cast("long").alias("taken"))
    part = wanted.where("want < supply").select(*names, "epoch", "want")
    rows = leaves.where("n_tokens > 0").select("doc_id", *names, "n_tokens", turn).withColumn("key", _key(F.col("epoch"), seed))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    cells = rows.groupBy(*names, "epoch", "bucket").agg(F.sum("n_tokens").alias("tokens")).join(part, [*names, "epoch"])
    before = Window.partitionBy(*names, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    last = cells.where("before < want and want <= before + tokens").select(*names, "epoch", "bucket", (F.col("want") - F.col("before")).alias("want"))
    within = rows.join(cut_lineage(last), [*names, "epoch", "bucket"]).groupBy(*names, "epoch", "want", "key").agg(F.sum("n_tokens").alias("n"))
    within = within.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy(*names, "epoch").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = within.where("start < want").groupBy(*names, "epoch").agg(F.max("key").alias("last"), F.max_by(F.col("want") - F.col("start"), "key").alias("taken"))
    return cut_lineage(whole.union(ends))


def _taken(rows: DataFrame, cut: DataFrame, tree: Tree, seed: int) -> DataFrame:
    cut = cut.select(*[F.col(c).alias(f"_c{c}") for c in tree.names], F.col("epoch").alias("_epoch"), F.col("last").alias("_last"), F.col("taken").alias("_part"))
    on = F.lit(True)
    for c in tree.names:
        on = on & (F.col(c) == F.col(f"_c{c}"))
    met = rows.where("n_tokens > 0").join(cut, on).withColumn("_at", _key(F.col("_epoch"), seed)).where("_at <= _last")
    return met.withColumn("_n_taken", F.when(F.col("_at") == F.col("_last"), F.least("n_tokens", "_part")).otherwise(F.col("n_tokens")))


def plan(docs: DataFrame, tree: Tree, share: float, epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(leaves, cuts): the node and tokens of each row, and what each leaf gives."""
    leaves = cut_lineage(_leaves(docs, tree))
    return leaves, cuts(leaves, budgets(leaves, tree, share, epochs), tree, epochs, seed)


def mix(docs: DataFrame, tree: Tree, share: float, epochs: int, seed: int) -> DataFrame:
    """One row per document and epoch in which it is taken: doc_id, the tree's levels, epoch,
    n_tokens and n_taken, which is less than n_tokens only for the last of a leaf.

    Missing or empty texts have no tokens and are never taken.  Missing nodes form nodes of their own,
    named ``""``.  Rows that share a doc_id share a place in the order and are taken together; the
    last such rows may give more than what is left.
    """
    leaves, cut = plan(docs, tree, share, epochs, seed)
    levels = [F.col(f"_{name}").alias(name) for name, _ in tree.levels]
    return _taken(leaves, cut, tree, seed).select("doc_id", *levels, F.col("_epoch").alias("epoch"), "n_tokens", F.col("_n_taken").alias("n_taken"))


def mixed_documents(docs: DataFrame, tree: Tree, share: float, epochs: int, seed: int) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` takes, whole, with their own columns; a document taken in
    several epochs comes as often.  The cuts, one row per leaf and epoch, meet the rows by an
    ordinary join: the planner broadcasts them where their size is known to be small, and splits
    large leaves where it is not."""
    _, cut = plan(docs, tree, share, epochs, seed)
    row = "_row"
    while row in docs.columns:
        row += "_"
    packed = docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    nodes = [F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(f"_{name}") for name, c in tree.levels]
    rows = packed.select(F.col(row).alias("_row"), "doc_id", *nodes, _n_tokens())
    return _taken(rows, cut, tree, seed).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
