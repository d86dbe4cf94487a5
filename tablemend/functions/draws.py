"""Repeatable random draws as Column expressions: normal, gamma and beta from hashes of a key.

A draw is a function of (seed, tag, key): running a task again gives the same one, and no state is carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemend.functions.expr import SEED, col, let, uniform

TRIES = 16  # of a gamma draw; each is taken with probability over 0.95, so all fail once in 10^20


def normal(tag: str, key: Column | str, seed: int = SEED) -> Column:
    """A draw from the standard normal distribution."""
    return F.sqrt(-2.0 * F.ln(uniform(f"{tag}.r", key, seed))) * F.cos(2 * math.pi * uniform(f"{tag}.a", key, seed))


def gamma(shape: Column | str, tag: str, key: Column | str, seed: int = SEED) -> Column:
    """A draw from the gamma distribution with scale 1, by rejection (Marsaglia and Tsang): tries are made from hashes of
    their number and the first good one counts.  A shape under 1 is drawn one larger and brought down."""
    key = col(key).cast("string")

    def drawn(p: Column) -> Column:
        a, key = p["a"], p["key"]
        d = F.when(a < 1, a + 1).otherwise(a) - 1.0 / 3

        def attempt(i: Column) -> Column:
            own = F.concat(i.cast("string"), F.lit("|"), key)

            def judged(q: Column) -> Column:
                x = q["x"]
                v = F.pow(1 + x / F.sqrt(9 * d), F.lit(3.0))
                good = (v > 0) & (F.ln(uniform(f"{tag}.u", own, seed)) < 0.5 * x * x + d - d * v + d * F.ln(F.when(v > 0, v)))
                return F.when(good, d * v)

            return let(judged, x=normal(tag, own, seed))

        first = F.coalesce(F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), attempt), lambda v: v.isNotNull()), F.lit(0)), d)
        return F.when(a < 1, first * F.pow(uniform(f"{tag}.s", key, seed), 1 / a)).otherwise(first)

    return let(drawn, a=col(shape).cast("double"), key=key)


def beta(a: Column | str, b: Column | str, tag: str, key: Column | str, seed: int = SEED) -> Column:
    """A draw from the beta distribution, as the share of one gamma draw in two."""
    return let(lambda g: g["x"] / (g["x"] + g["y"]), x=gamma(a, f"{tag}.x", key, seed), y=gamma(b, f"{tag}.y", key, seed))
