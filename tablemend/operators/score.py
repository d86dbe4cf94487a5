"""Scoring jobs that need a lookup beside the row: each adds one log-likelihood column.

Plain row-local models are the expressions in ``functions.loglik``; use them directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemend.functions import loglik
from tablemend.functions.expr import is_abbreviation
from tablemend.functions.units import Transform, unit_scores
from tablemend.operators.inject import expansion_pairs
from tablemend.operators.spread import attach


def score_swap(records: DataFrame, options: DataFrame, observed: str, value: str, on: Sequence[str], rate: str, name: str = "loglik") -> DataFrame:
    """Swap likelihood of each record's observed value given its clean one; the domain is the
    record's group's, and holds the clean value or a missing reading is impossible."""
    sizes = options.groupBy(*on).agg(F.count("*").alias("_m"))
    member = options.select(*on, F.col("option").alias(value), F.lit(True).alias("_in")).distinct()
    joined = attach(attach(records, sizes, on), member, [*on, value])
    score = loglik.swap(observed, value, F.coalesce("_m", F.lit(1)), rate, F.coalesce("_in", F.lit(False)))
    return joined.withColumn(name, score).drop("_m", "_in")


def score_uniform(records: DataFrame, options: DataFrame, on: Sequence[str], name: str = "loglik") -> DataFrame:
    sizes = options.groupBy(*on).agg(F.count("*").alias("_m"))
    return attach(records, sizes, on).withColumn(name, loglik.uniform_choice("_m")).drop("_m")


def score_proportional(records: DataFrame, weights: DataFrame, value: str, on: Sequence[str] = (), name: str = "loglik") -> DataFrame:
    """Weight of the record's value among (group, option, weight); equal options add up."""
    summed = weights.groupBy(*on, F.col("option").alias(value)).agg(F.sum("weight").alias("_w"))
    return attach(records, summed, [*on, value]).withColumn(name, loglik.proportional_choice("_w")).drop("_w")


def score_units(readings: DataFrame, x: str, mean: str, std: float, units: Sequence[Transform]) -> DataFrame:
    """One row per reading and declared unit."""
    scored = unit_scores(x, F.col(mean), F.lit(std), units)
    return readings.select(*readings.columns, F.inline(scored))


def score_abbreviation(pairs: DataFrame, options: DataFrame, observed: str, value: str, on: Sequence[str] = (), name: str = "loglik") -> DataFrame:
    """Likelihood that ``observed`` spells out the short form ``value``."""
    shorts = pairs.select(*on, F.col(value).alias("short")).distinct()
    spelled = expansion_pairs(shorts, options, on).groupBy(*on, "short").agg(F.count("*").alias("_m"))
    member = options.select(*on, F.col("option").alias(value), F.lit(True).alias("_in")).distinct()
    joined = attach(attach(pairs, spelled.withColumnRenamed("short", value), [*on, value]), member, [*on, value])
    score = loglik.abbreviation(
        observed, value, is_abbreviation(value, observed), F.greatest(F.coalesce("_m", F.lit(1)), F.lit(1)), F.coalesce("_in", F.lit(False))
    )
    return joined.withColumn(name, score).drop("_m", "_in")
