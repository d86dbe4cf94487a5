"""From scores to decisions: log-sums, posteriors, best, sampled and top-k candidates.

Everything here aggregates with map-side combining instead of gathering a record's
or entity's candidates in one task, so a very large group stays spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.functions.expr import col, r6, uniform
from tablemend.operators.spread import no_clash, spread_join


def with_group(df: DataFrame, keys: Sequence[str], stats: DataFrame, how: str = "inner") -> DataFrame:
    """Attach a group's statistics to its rows (a missing key is a group too); with no keys
    they are one row, read as scalars."""
    extra = [c for c in stats.columns if c not in keys]
    if not keys:
        return df.select("*", *[stats.select(c).scalar().alias(c) for c in extra])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return df.alias("a").join(stats.alias("b"), cond, how).select("a.*", *[F.col(f"b.{c}") for c in extra])


def log_sum_exp(df: DataFrame, keys: Sequence[str], x: str, name: str = "lse") -> DataFrame:
    """ln sum exp per group, shifted by the group's maximum."""
    top = df.groupBy(*keys).agg(F.max(x).alias("_m"))
    shifted = with_group(df, keys, top)
    return (
        shifted.groupBy(*keys)
        .agg(F.max("_m").alias("_m"), F.sum(F.exp(F.col(x) - F.col("_m"))).alias("_s"))
        .select(*keys, (F.col("_m") + F.ln("_s")).alias(name))
    )


def log_add(a: Column | str, b: Column | str) -> Column:
    """ln(exp a + exp b)."""
    a, b = col(a), col(b)
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def normalize(df: DataFrame, keys: Sequence[str], weight: str, name: str = "p") -> DataFrame:
    """Weights divided by their group's sum."""
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("_t"))
    return with_group(df, keys, totals).withColumn(name, F.try_divide(F.col(weight), F.col("_t"))).drop("_t")


def posterior(df: DataFrame, keys: Sequence[str], score: str, name: str = "p") -> DataFrame:
    """Probability of each candidate among those of its record."""
    return (
        with_group(df, keys, log_sum_exp(df, keys, score, "_lse"))
        .withColumn(name, F.exp(F.col(score) - F.col("_lse")))
        .drop("_lse")
    )


def best(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """The highest score per record, ties to the smallest ``tie``.  Scores are compared
    rounded to 6 decimals, so the order of floating sums cannot decide."""
    keep = list(keep if keep is not None else [c for c in df.columns if c not in keys])
    rank = F.struct((-r6(score)).alias("_rank"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*keep), rank).alias("_b"))
    return picked.select(*keys, "_b.*")


def top_k(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], k: int, name: str = "rank") -> DataFrame:
    """The k best candidates per record; each task drops what cannot qualify before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(r6(score).desc(), *[F.col(t) for t in tie])
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def cumulative(df: DataFrame, keys: Sequence[str], p: str, order: Sequence[str]) -> DataFrame:
    """Half-open interval [lo, hi) of each candidate on the unit line of its group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hi = F.round(F.sum(p).over(w), 9)
    return df.withColumn("hi", hi).withColumn("lo", F.lag("hi", 1, 0.0).over(Window.partitionBy(*keys).orderBy(*order)))


def sample(records: DataFrame, row_key: str, intervals: DataFrame, keys: Sequence[str], tag: str = "link") -> DataFrame:
    """One candidate per record by weight.  A record of a group without candidates stays, with nothing chosen.

    A group's unit line is cut into as many equal cells as it has candidates; an interval is listed under the cells
    it touches, at most two per candidate on average, and a record meets those of its own cell only.  So the
    work follows the records, however many candidates their group has, and a large group is spread over its cells.
    """
    rest = [c for c in intervals.columns if c not in keys and c not in ("lo", "hi")]
    no_clash(records, [*rest, "_cells", "_rows", "_u", "_cell"])
    cells = intervals.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_cells"))
    sizes = with_group(cells, keys, records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))) if keys else cells.withColumn("_rows", F.lit(0))
    last = F.col("_cells") - 1
    touched = F.sequence(F.least(F.floor(F.col("lo") * F.col("_cells")).cast("int"), last), F.least(F.floor(F.col("hi") * F.col("_cells")).cast("int"), last))
    listed = with_group(intervals, keys, cells).where("hi > lo").withColumn("_cell", F.explode(touched))
    drawn = records.withColumn("_u", uniform(tag, row_key) * 0.999999998)
    drawn = spread_join(drawn, sizes, keys, "_rows") if keys else with_group(drawn, keys, sizes)
    r = drawn.withColumn("_cell", F.floor(F.col("_u") * F.col("_cells")).cast("int")).alias("r")
    i = listed.alias("i")
    cond = (F.col("r._cell") == F.col("i._cell")) & (F.col("r._u") >= F.col("i.lo")) & (F.col("r._u") < F.col("i.hi"))
    for k in keys:
        cond = F.col(f"r.`{k}`").eqNullSafe(F.col(f"i.`{k}`")) & cond
    return r.join(i, cond, "left").select(*[F.col(f"r.`{c}`") for c in records.columns], *[F.col(f"i.`{c}`") for c in rest])


def effective_candidates(posteriors: DataFrame, keys: Sequence[str], p: str = "p", name: str = "ess") -> DataFrame:
    """1 / sum p^2: how many candidates a record is really torn between."""
    return posteriors.groupBy(*keys).agg((1 / F.sum(F.col(p) * F.col(p))).alias(name))


def accept_or_keep(pairs: DataFrame, old_score: str, new_score: str, row_key: str, tag: str = "accept") -> DataFrame:
    """Flag ``accepted``: take the proposal with probability min(1, exp(new - old))."""
    ratio = F.exp(F.least(F.col(new_score) - F.col(old_score), F.lit(0.0)))
    return pairs.withColumn("accepted", F.coalesce(uniform(tag, row_key) < ratio, F.lit(False)))
