"""Observed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablemend.functions.expr import key_hash


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, format: str | None = None) -> DataFrame:
    """A table from CSV (with header), Parquet, JSON or ORC, by extension unless ``format`` is given.
    CSV types are inferred only when no schema is named."""
    kind = format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    return reader.format(kind).load(path)


def bind_observed(df: DataFrame, key: Sequence[str], name: str = "row_id") -> DataFrame:
    """Give each record a stable id from its business key: the same in every run and on retries."""
    return df.withColumn(name, key_hash(*key))


def combine(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Several observed tables, aligned by column name, tagged with the dataset they came from."""
    out = None
    for name, df in datasets.items():
        tagged = df.withColumn("dataset", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
