"""Writing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str, format: str, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def output_dir(base: str, name: str, timestamp: bool = True) -> str:
    """``base/name``, or a new version of it per run."""
    stamp = datetime.now(timezone.utc).strftime("-%Y-%m-%dT%H%M%S.%f") if timestamp else ""
    return f"{base.rstrip('/')}/{name}{stamp}"


def save_tables(directory: str, tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None, format: str = "csv") -> None:
    """One ``inferred_<class>`` per entity class.  Internal columns (leading underscore) are left out."""
    for name, table in tables.items():
        keep = (columns or {}).get(name) or [c for c in table.columns if not c.startswith("_")]
        _write(table.select(*keep), f"{directory}/inferred_{name}", format)


def save_results(
    base: str,
    name: str,
    reconstructed: Mapping[str, DataFrame],
    entities: Mapping[str, DataFrame],
    timestamp: bool = True,
    format: str = "csv",
) -> str:
    """The repaired flat tables and all entity tables, in a directory of this run."""
    directory = output_dir(base, name, timestamp)
    for cls, df in reconstructed.items():
        _write(df, f"{directory}/reconstructed_{cls}", format)
    save_tables(directory, entities, format=format)
    return directory


def to_json_rows(df: DataFrame, key: str = "entity_id", columns: Sequence[str] | None = None) -> DataFrame:
    """Each row of a table as one JSON text."""
    cols = list(columns or [c for c in df.columns if c != key])
    return df.select(F.col(key), F.to_json(F.struct(*[F.col(c) for c in cols])).alias("json"))


def save_json(df: DataFrame, path: str) -> None:
    _write(df, path, "json")


def report_progress(spark: SparkSession, path: str, sweep: int, stage: str, **metrics: float) -> None:
    """Append one metrics row; only summary numbers, never data, pass through the driver."""
    row = [(sweep, stage, datetime.now(timezone.utc).isoformat(), {k: float(v) for k, v in metrics.items()})]
    schema = "sweep int, stage string, at string, metrics map<string,double>"
    _write(spark.createDataFrame(row, schema), path, "json", "append")
