"""Entity tables and links as plain DataFrames: lookups, pruning, rebuilding the flat table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def referring_rows(paths: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Records that refer to an entity, over every path: {path: (rows, row key, entity key)}.
    A record referring twice over different paths appears once per path."""
    out = None
    for name, (rows, key, entity) in paths.items():
        part = rows.where(F.col(entity).isNotNull()).select(
            F.lit(name).alias("path"), F.col(entity).cast("string").alias("entity"), F.col(key).cast("string").alias("row")
        )
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def referring_along(records: DataFrame, key: str, ref: str, steps: Sequence[tuple[str, DataFrame, str, str | None]]) -> DataFrame:
    """Records that refer to an entity directly or through other entities: (path, entity, row).

    ``steps`` lists (class, table, its key, its reference to the next class) along the path that
    starts with the records' column ``ref``.  A record is listed under the entity of each class it
    reaches; where a reference is missing its path ends.
    """
    at = records.select(F.col(key).cast("string").alias("row"), F.col(ref).alias("_ref"))
    out, path = None, ""
    for name, table, own, nxt in steps:
        path = f"{path}.{name}" if path else name
        at = at.where(F.col("_ref").isNotNull())
        part = at.select(F.lit(path).alias("path"), F.col("_ref").cast("string").alias("entity"), "row")
        out = part if out is None else out.unionByName(part)
        if nxt is None:
            break
        onward = table.select(F.col(own).alias("_own"), F.col(nxt).alias("_next"))
        at = at.join(onward, F.col("_ref") == F.col("_own")).select("row", F.col("_next").alias("_ref"))
    return out.distinct()


def entity_log(before: DataFrame, after: DataFrame, name: str, key: str = "entity_id") -> DataFrame:
    """Entities of class ``name`` that one version of a table has and the other lacks: (class, entity_id,
    change), the change being ``new`` or ``deleted``."""
    b, a = (df.select(F.col(key).alias("entity_id")).distinct() for df in (before, after))
    gone = b.join(a, "entity_id", "left_anti").withColumn("change", F.lit("deleted"))
    new = a.join(b, "entity_id", "left_anti").withColumn("change", F.lit("new"))
    return gone.unionByName(new).select(F.lit(name).alias("class"), "entity_id", "change")


def prune_orphans(entities: DataFrame, links: DataFrame, key: str = "entity_id") -> DataFrame:
    """Entities that some record still refers to."""
    return entities.join(links.select(key), key, "left_semi")


def prune_cascade(chain: Sequence[tuple[str, DataFrame, str, str | None]], links: DataFrame, key: str) -> dict[str, DataFrame]:
    """Prune along a reference chain, the referring class first.

    ``chain`` lists (class, table, its key, its reference to the next class).
    """
    kept: dict[str, DataFrame] = {}
    used = links.select(F.col(key).alias("_ref"))
    for name, table, own, nxt in chain:
        kept[name] = table.join(used, F.col(own) == F.col("_ref"), "left_semi")
        if nxt:
            used = kept[name].select(F.col(nxt).alias("_ref"))
    return kept


def entity_rows(name: str, table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Long form of an entity table: class, entity_id, attribute, value."""
    return table.unpivot(
        [F.col(key).alias("entity_id")], [F.col(c).cast("string").alias(c) for c in columns], "attribute", "value"
    ).select(F.lit(name).alias("class"), "entity_id", "attribute", "value")


def reconstruct(original: DataFrame, repaired: DataFrame, key: str = "row_id") -> DataFrame:
    """The flat table again, in key order: repaired columns of the records that ``repaired`` has, all
    else as it came."""
    fixed = [c for c in repaired.columns if c != key]
    joined = original.alias("o").join(repaired.withColumn("_hit", F.lit(True)).alias("r"), key, "left")

    def cell(c: str):
        return F.when(F.col("r._hit"), F.col(f"r.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c)

    return joined.select(
        *[cell(c) if c in fixed else F.col(f"o.`{c}`") if c != key else F.col(key) for c in original.columns]
    ).orderBy(key)
