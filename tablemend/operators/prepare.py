"""Projection, derivation and missing-cell policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.functions.models import ErrorModel


def align_columns(df: DataFrame, mapping: Mapping[str, str | tuple[str, str]], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Rename source columns to model attributes.

    ``column: attr`` maps a column whose clean and dirty value are the same attribute;
    ``column: (clean, dirty)`` reads the column as the dirty attribute and leaves an
    empty slot for the clean one.  Names may hold spaces or dots.
    """
    out: list[Column] = [F.col(c) for c in keep]
    for name, target in mapping.items():
        source = F.col(f"`{name}`")
        if isinstance(target, str):
            out.append(source.alias(target))
        else:
            clean, dirty = target
            out += [F.lit(None).cast(df.schema[name].dataType).alias(clean), source.alias(dirty)]
    return df.select(*out)


def follow(df: DataFrame, path: Sequence[tuple[DataFrame, str, str, Mapping[str, str]]]) -> DataFrame:
    """Dereference a chain of references: each hop is (table, key here, key there, {attr: name})."""
    for table, here, there, attrs in path:
        dim = table.select(F.col(there).alias("_there"), *[F.col(a).alias(n) for a, n in attrs.items()])
        df = df.join(dim, F.col(here) == F.col("_there"), "left").drop("_there")
    return df


def cells(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Long form: one row per (record, column), values as text."""
    return df.unpivot(
        [F.col(k) for k in keep],
        [F.col(f"`{c}`").cast("string").alias(c) for c in columns],
        "column",
        "value",
    )


def missing_policy(df: DataFrame, columns: Mapping[str, ErrorModel | None]) -> DataFrame:
    """Per column: cells observed, missing cells kept as observations, missing cells to impute.

    ``columns[c]`` is the error model between the column and its clean attribute, or None
    where the column is the attribute.  A missing cell is evidence only if there is a model
    and it observes missing.
    """
    stats = []
    for c, model in columns.items():
        explicit = model is not None and model.observes_missing
        null = F.col(f"`{c}`").isNull()
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(~null).alias("n_observed"),
                F.count_if(null & F.lit(explicit)).alias("n_missing_as_observation"),
                F.count_if(null & ~F.lit(explicit)).alias("n_to_impute"),
            )
        )
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def align_types(df: DataFrame, like: DataFrame) -> DataFrame:
    """Cast every column whose type differs from ``like``'s column of that name to text in common."""
    types = {f.name: f.dataType for f in like.schema}
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("string").alias(f.name)
            if f.name in types and types[f.name] != f.dataType
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def position(
    df: DataFrame, digest: str, key: str | None = None, prefix: int = 4, name: str = "row_no", by: Sequence[str] = ()
) -> DataFrame:
    """1-based position of each row in the order of ``(digest, key)``, overall or per group.

    ``digest`` is an md5 text column, so its first hex digits split the rows evenly:
    rows are counted per prefix, only those counts (16**prefix per group at most) are
    summed in order, and each prefix numbers its own rows.  Neither one global sort nor
    one task per group is needed.
    """
    keys = [*by, "_bucket"]
    bucketed = df.withColumn("_bucket", F.substring(digest, 1, prefix))
    sizes = bucketed.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys).orderBy(digest, *([key] if key else []))
    return (
        bucketed.join(starts if by else F.broadcast(starts), keys)
        .withColumn(name, F.col("_start") + F.row_number().over(within))
        .drop("_bucket", "_start")
    )
