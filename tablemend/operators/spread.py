"""Joining many rows to a table of their keys when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000


def _same(left: str, right: str, on: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return cond


def no_clash(rows: DataFrame, new: Sequence[str]) -> None:
    """Raises if ``rows`` already has one of the ``new`` columns: the older one would pass for the result."""
    taken = sorted(set(new) & set(rows.columns))
    if taken:
        raise ValueError(f"rename {taken} first: the result has columns of these names")


def spread_join(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: Column | str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``table``, which says in ``weight`` how many rows each key has.

    A key with more than 1/1000 of the total weight is hot; there cannot be more than 1000 of
    those, so their entries are broadcast whatever the table's size.  Their rows are answered
    there and spread evenly over the shuffle that serves all other keys, none of which is large.
    Missing keys match missing keys.  ``how`` is left or inner.  Rows should carry an id.  A column of
    ``table`` that ``rows`` has too is an error.
    """
    weighted = table.withColumn("_weight", F.coalesce(weight if isinstance(weight, Column) else F.col(weight), F.lit(0)))
    extra = [c for c in table.columns if c not in on]
    no_clash(rows, extra)
    packed = weighted.select(*on, "_weight", F.struct(F.lit(True).alias("_hit"), *[F.col(f"`{c}`") for c in extra]).alias("_t"))
    keys = packed.groupBy(*on).agg(F.max("_weight").alias("_w"))  # a key may have several entries
    limit = keys.select(F.sum("_w") / HOT_KEYS).scalar()
    hot = packed.where(F.col("_weight") > limit).select(*on, F.col("_t").alias("_hot"))
    cold = packed.where(F.col("_weight") <= limit).select(*on, F.col("_t").alias("_cold"), F.lit(0).alias("_salt"))
    met = rows.alias("r").join(F.broadcast(hot).alias("h"), _same("r", "h", on), "left").select("r.*", "h._hot")
    # From the row itself, not at random: a task run again must place its rows as before.
    own = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind]
    salt = F.when(F.col("_hot").isNotNull(), (F.pmod(F.xxhash64(*own), F.lit(HOT_KEYS)) + 1).cast("int")).otherwise(0)
    met = met.withColumn("_salt", salt)
    out = met.alias("r").join(cold.alias("c"), _same("r", "c", [*on, "_salt"]), "left")
    found = F.coalesce(F.col("r._hot"), F.col("c._cold"))
    out = out.select(*[F.col(f"r.`{c}`") for c in rows.columns], found.alias("_t"))
    if how == "inner":
        out = out.where(F.col("_t").isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_t.`{c}`").alias(c) for c in extra])


def attach(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left :func:`spread_join` with a table that does not know how many rows each of its keys has: the rows are counted
    first.  As in a plain join, missing keys match nothing."""
    known = table
    for k in on:
        known = known.where(F.col(f"`{k}`").isNotNull())
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    # A row for each key that the rows have, so that large ones are spread whether the table has them or not.
    extra = [c for c in table.columns if c not in on]
    found = counts.alias("a").join(known.alias("b"), _same("a", "b", on), "left").select("a.*", *[F.col(f"b.`{c}`") for c in extra])
    return spread_join(rows, found, on, "_rows").drop("_rows")
