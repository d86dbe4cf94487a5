"""Log-likelihoods and log-priors as Column expressions.

Each takes columns and returns one column; natural logs, finite everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemend.functions.expr import (
    IMPOSSIBLE,
    IMPOSSIBLE_TYPOS,
    LOG_ZERO,
    MINUTES_PER_DAY,
    col,
    safe_ln,
)

# Fixed values of the typo model.
LETTERS_PER_TYPO = 5.0
NO_TYPO_RATE = 0.9
TYPO_LETTERS = 26
# Fixed values of the name-form models.
FULL_NAME = 3 * math.log(0.9)
DROPPED_MIDDLE = math.log(0.1)
NAME_AS_IS = math.log(0.9999)
NAME_INITIAL = math.log(0.0001)
NAME_MISSING = -5.0
# Fixed values of the text prior.
ALPHABET = "abcdefghijklmnopqrstuvwxyz ."
UNUSUAL_LETTER = -1000.0


def typos(distance: Column | str, observed: Column | str, word: Column | str, max_typos: int | None = None) -> Column:
    """Typos at ``distance`` edits: negative-binomial count, uniform places and letters."""
    k, observed, word = col(distance), col(observed), col(word)
    size = F.length(word).cast("double")
    r = F.ceil(size / LETTERS_PER_TYPO).cast("double")

    def way(i: Column) -> Column:
        return F.ln((r - 1 + i) / i)

    if max_typos is None:
        ways = F.when(k > 0, F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda acc, i: acc + way(i))).otherwise(0.0)
    else:
        ways = F.lit(0.0)
        for i in range(1, max_typos + 1):
            ways = ways + F.when(k >= i, way(F.lit(float(i)))).otherwise(0.0)
    per_typo = math.log(1 - NO_TYPO_RATE) - math.log(TYPO_LETTERS) / 2
    score = ways + r * math.log(NO_TYPO_RATE) + k * (per_typo - F.ln(size))
    empty = F.when(k == 0, F.lit(0.0)).otherwise(F.lit(IMPOSSIBLE_TYPOS))
    out = F.when(observed.isNull(), F.lit(0.0))
    if max_typos is not None:
        out = out.when(k > max_typos, F.lit(IMPOSSIBLE_TYPOS))
    return out.when(size == 0, empty).otherwise(score)


def swap(observed, value, n_options, rate, value_in_options=None) -> Column:
    """Observed equals the value, or is swapped for any of ``n_options`` at ``rate``."""
    observed, value, rate = col(observed), col(value), col(rate)
    inside = F.lit(True) if value_in_options is None else col(value_in_options)
    return (
        F.when(observed.isNull() & inside, F.lit(0.0))
        .when(observed.isNull(), F.lit(IMPOSSIBLE))
        .when(observed == value, safe_ln(1 - rate))
        .otherwise(safe_ln(rate) - F.ln(col(n_options).cast("double")))
    )


def uniform_choice(n_options) -> Column:
    """Uniform over ``n_options``; deliberately without a membership test."""
    return -F.ln(col(n_options).cast("double"))


def proportional_choice(weight) -> Column:
    """Weight already summed over matching options; a missing one means no option matched."""
    return safe_ln(F.coalesce(col(weight), F.lit(0.0)))


def time_of_day(text) -> Column:
    from tablemend.functions.expr import is_time

    return F.when(is_time(text), F.lit(-math.log(MINUTES_PER_DAY))).otherwise(F.lit(LOG_ZERO))


def number_code(value) -> Column:
    return -F.when(col(value) > 0, F.ln(col(value).cast("double"))).otherwise(F.lit(-LOG_ZERO))


def unmodelled() -> Column:
    return F.lit(0.0)


def gaussian(x, mean, std) -> Column:
    z = (col(x) - col(mean)) / col(std)
    return -0.5 * z * z - F.ln(col(std)) - F.lit(0.5 * math.log(2 * math.pi))


def gaussian_in_unit(x, mean, std, unit) -> Column:
    """Density of a reading shown in ``unit`` (see ``Transform``), change of variables included."""
    base = unit.backward(col(x))
    return gaussian(base, mean, std) - safe_ln(F.abs(unit.deriv(base)))


def full_name(observed, first, middle, last) -> Column:
    observed = F.lower(col(observed))
    first, middle, last = (F.coalesce(col(c), F.lit("")) for c in (first, middle, last))
    return (
        F.when(observed.isNull(), F.lit(0.0))
        .when(observed == F.lower(F.concat_ws(" ", first, middle, last)), F.lit(FULL_NAME))
        .when(observed == F.lower(F.concat_ws(" ", first, last)), F.lit(DROPPED_MIDDLE))
        .otherwise(F.lit(IMPOSSIBLE))
    )


def one_name(observed, name) -> Column:
    """A name written out or as an initial."""
    observed, name = col(observed), col(name)
    blank = name.isNull() | (name == "")
    missing = F.when(blank, F.lit(0.0)).when(F.contains(name, F.lit("*")), F.lit(IMPOSSIBLE)).otherwise(NAME_MISSING)
    return (
        F.when(observed.isNull(), missing)
        .when(blank, F.lit(IMPOSSIBLE))
        .when(F.lower(observed) == F.lower(name), F.lit(NAME_AS_IS))
        .when(F.lower(observed) == F.lower(F.concat(F.substring(name, 1, 1), F.lit("."))), F.lit(NAME_INITIAL))
        .otherwise(F.lit(IMPOSSIBLE))
    )


def abbreviation(observed, value, matches, n_expansions, value_in_options=None) -> Column:
    """``value`` is a short form of ``observed``, one of ``n_expansions`` options it could stand for."""
    inside = F.lit(True) if value_in_options is None else col(value_in_options)
    return (
        F.when(col(observed).isNull() & inside, F.lit(0.0))
        .when(col(observed).isNull(), F.lit(IMPOSSIBLE))
        .when(col(matches), -safe_ln(col(n_expansions).cast("double")))
        .otherwise(F.lit(IMPOSSIBLE))
    )


def link_existing(n, total, strength, discount) -> Column:
    """Pitman-Yor weight of joining an entity with ``n`` of ``total`` references."""
    return safe_ln(col(n) - col(discount)) - F.ln(col(total) + col(strength))


def link_new(n_entities, total, strength, discount) -> Column:
    return safe_ln(col(n_entities) * col(discount) + col(strength)) - F.ln(col(total) + col(strength))
