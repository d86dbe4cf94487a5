"""Invertible transforms of a numeric reading."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemend.functions.expr import col, r6
from tablemend.functions.loglik import gaussian_in_unit


@dataclass(frozen=True)
class Transform:
    """``forward`` shows a base value in this unit, ``backward`` undoes it, ``deriv`` is the slope of ``forward``."""

    name: str
    forward: Callable[[Column], Column]
    backward: Callable[[Column], Column]
    deriv: Callable[[Column], Column]

    @classmethod
    def scale(cls, name: str, factor: float) -> "Transform":
        return cls(name, lambda x: x * factor, lambda x: x / factor, lambda x: F.lit(factor))


IDENTITY = Transform("identity", lambda x: x, lambda x: x, lambda x: F.lit(1.0))
THOUSANDS = Transform("thousands", lambda x: x / 1000.0, lambda x: x * 1000.0, lambda x: F.lit(1 / 1000.0))


def unit_scores(x: Column | str, mean, std, units: Sequence[Transform]) -> Column:
    """Array of (unit, loglik, base value), one entry per declared unit."""
    return F.array(
        *[
            F.struct(
                F.lit(u.name).alias("unit"),
                gaussian_in_unit(x, mean, std, u).alias("loglik"),
                u.backward(col(x)).alias("base"),
            )
            for u in units
        ]
    )


def best_unit(x: Column | str, mean, std, units: Sequence[Transform]) -> Column:
    """The likeliest unit's entry; ties to the one declared first.  Decided inside the row."""
    base = [u.backward(col(x)) for u in units]
    ranked = [
        F.struct((-r6(gaussian_in_unit(x, mean, std, u))).alias("rank"), F.lit(i).alias("i"), F.lit(u.name).alias("unit"), b.alias("base"))
        for i, (u, b) in enumerate(zip(units, base))
    ]
    return F.array_min(F.array(*ranked))
