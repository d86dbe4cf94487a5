"""Two whole-table cleanings for shapes that recur: conflicting sources, and mixed-unit listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions.units import IDENTITY, THOUSANDS, Transform
from tablemend.operators.learn import Beta, NormalMean
from tablemend.operators.prepare import cells
from tablemend.plans.jobs import impute, repair_typos, truth_discovery_em, unit_correct


def clean_claims(
    records: DataFrame,
    entity: str,
    source: str,
    fields: Sequence[str],
    rounds: int = 5,
    prior: Beta = Beta(10.0, 50.0),
    owns: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Many sources report several fields of the same entities and contradict each other.

    Returns the records with every field replaced by the consensus for its entity (so missing
    cells are filled too), and the error rate learned for each source over all its fields.
    ``owns`` says, from the entity and source columns, that the source is the entity's own.
    """
    claims = cells(records, fields, keep=[entity, source]).withColumnRenamed("column", "_field")
    truth, rates = truth_discovery_em(claims, [entity, "_field"], "value", source, rounds, prior, owns)
    wide = truth.groupBy(entity).agg(F.struct(*[F.max(F.when(F.col("_field") == f, F.col("value"))).alias(f"c{i}") for i, f in enumerate(fields)]).alias("value"))
    joined = records.alias("r").join(wide.alias("w"), F.col(f"r.`{entity}`") == F.col(f"w.`{entity}`"), "left")
    # A record of no entity, or of one without any claim, keeps its own.
    out = {f: F.coalesce(F.col(f"w.value.c{i}").cast(records.schema[f].dataType), F.col(f"r.`{f}`")).alias(f) for i, f in enumerate(fields)}
    return joined.select(*[out.get(c, F.col(f"r.`{c}`")) for c in records.columns]), rates


def clean_listings(
    records: DataFrame,
    place_key: str,
    place: str,
    area: str,
    kind: str,
    amount: str,
    prior: NormalMean = NormalMean(1500.0, 1000.0),
    std: float = 150.0,
    units: Sequence[Transform] = (IDENTITY, THOUSANDS),
    *,
    max_typos: int,
) -> DataFrame:
    """Listings with a mistyped place, missing area or kind, and amounts in mixed units.

    The place is repaired among places sharing ``place_key``; area and kind are filled from
    their place; the amount is brought to one unit, given what its area, place and kind
    usually cost, and rounded.
    """
    named = repair_typos(records, place, [place_key], max_typos=max_typos, out="_place", score="_score").withColumn(place, F.col("_place")).drop("_place", "_score")
    filled = impute(named, area, [place_key, place])
    filled = impute(filled.drop("was_missing"), kind, [place_key, place]).drop("was_missing")
    fixed = unit_correct(filled, amount, [area, place_key, kind], units, prior, std)
    return fixed.withColumn(amount, F.col("corrected")).drop("unit", "corrected", "mean")
