"""Scalar building blocks shared by every job.  All are JVM-side Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named log-penalties and tolerances the models are defined with.
IMPOSSIBLE_TYPOS = -1e5
IMPOSSIBLE = -1000.0
LOG_ZERO = -1e9  # finite stand-in for ln(0): NULL would silently drop out of sums
REL_TOL = 1.5e-8

SEED = 7


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(body: Callable[[Column], Column], **bound: Column | str) -> Column:
    """``body`` of a struct whose fields are computed once, however often the body names them."""
    packed = F.struct(*[col(c).alias(n) for n, c in bound.items()])
    return F.element_at(F.transform(F.array(packed), body), 1)


def r6(c: Column | str) -> Column:
    return F.round(col(c), 6)


def safe_ln(c: Column | str) -> Column:
    c = col(c)
    return F.when(c > 0, F.ln(c)).otherwise(F.lit(LOG_ZERO))


def ln_gamma(x: Column | str) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series, arguments below 8 shifted up by 8.

    Keeps Pitman-Yor and negative-binomial terms at one expression per row,
    where a sum over 1..n would need an array as long as the cluster.
    """
    x = col(x).cast("double")
    small = x < 8
    y = F.when(small, x + 8).otherwise(x)
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    inv2 = 1 / (y * y)
    series = (F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * F.lit(1 / 1680)))) / y
    value = (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series
    return F.when(small, value - F.ln(product)).otherwise(value)


def uniform(tag: str, key: Column | str, seed: int = SEED) -> Column:
    """A repeatable draw in (0, 1) for each key: 32 bits of an md5, centred in its cell."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{tag}|"), col(key).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def key_hash(*cols: Column | str) -> Column:
    """A stable row or entity id from its business key.

    Parts are written behind their length, missing ones as ``~``, so that different keys are
    different texts.
    """
    parts = [col(c).cast("string") for c in cols]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("~")) for p in parts]))


def approx_equal(a: Column | str, b: Column | str, rtol: float = REL_TOL) -> Column:
    """Null-safe equality of numbers up to a relative tolerance."""
    a, b = col(a), col(b)
    close = F.abs(a - b) <= rtol * F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


def is_abbreviation(short: Column | str, long: Column | str) -> Column:
    """Whether ``short`` is, ignoring case, a subsequence of ``long``."""
    s, target = F.lower(col(short)), F.lower(col(long))
    matched = F.aggregate(
        F.split(target, ""),
        F.lit(1),
        lambda at, ch: F.when(F.substr(s, at, F.lit(1)) == ch, at + 1).otherwise(at),
    )
    return matched > F.length(s)


# The accepted text form of a time of day, and its number of minutes.
TIME_PATTERN = r"^\d?\d:\d\d [ap]\.m\.$"
MINUTES_PER_DAY = 1440


def is_time(c: Column | str) -> Column:
    return F.rlike(col(c), F.lit(TIME_PATTERN))


def time_text(ts: Column | str) -> Column:
    """``h:mm a.m.`` / ``h:mm p.m.`` text of a timestamp."""
    ts = col(ts)
    hour, minute = F.hour(ts), F.minute(ts)
    return F.concat(
        F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12).cast("string"),
        F.lit(":"),
        F.lpad(minute.cast("string"), 2, "0"),
        F.when(hour < 12, F.lit(" a.m.")).otherwise(F.lit(" p.m.")),
    )


def blocking_key(c: Column | str) -> Column:
    """First letter of the text plus the last letter of its first word."""
    c = col(c)
    word = F.split_part(c, F.lit(" "), F.lit(1))
    return F.concat(F.substring(c, 1, 1), F.right(word, F.lit(1)))


def same_text(a: Column | str, b: Column | str) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def owner_rate(owns: Column, rate: Column | str, trusted: float = 1e-5) -> Column:
    """Error rate of a claim: a tiny fixed one when the source owns the entity."""
    return F.when(owns, F.lit(trusted)).otherwise(col(rate))


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
