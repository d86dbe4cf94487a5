"""Sufficient statistics and conjugate updates, each one grouped aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions import draws
from tablemend.functions.expr import SEED, key_hash, ln_gamma, safe_ln
from tablemend.operators.choose import best, with_group
from tablemend.operators.spread import no_clash, spread_join
from tablemend.session import is_small

FEW_PARAMS = 1_000_000  # rows; their values may take 32 MB


# --- parameter declarations -------------------------------------------------

@dataclass(frozen=True)
class Beta:
    """Prior of an error rate; ``Beta.odds(o)`` weighs the odds as four observations."""

    a: float = 1.0
    b: float = 3.0

    @classmethod
    def odds(cls, odds: float) -> "Beta":
        return cls(4 * odds, 4 * (1 - odds))

    def stats(self, observed: str, value: str, weight: str | None = None) -> list[Column]:
        return error_counts(observed, value, weight)

    def posterior(self) -> Column:
        return (self.a + F.col("errors")) / (self.a + self.b + F.col("errors") + F.col("matches"))

    @property
    def mean(self) -> float:
        return self.a / (self.a + self.b)


@dataclass(frozen=True)
class Dirichlet:
    """Prior of category weights: the same for all options, or a column of the options table."""

    concentration: float | str = 1.0


@dataclass(frozen=True)
class NormalMean:
    """Prior of a mean; the default spread is half its size."""

    mean: float
    std: float | None = None

    @property
    def spread(self) -> float:
        return 0.5 * abs(self.mean) if self.std is None else self.std


class Parameter(Protocol):
    """A learned parameter: statistics as aggregates, and a column computing its value from them.
    Any object with these two methods can be learned by ``learn``, globally or per key."""

    def stats(self, observed: str, value: str, weight: str | None = None) -> list[Column]: ...

    def posterior(self) -> Column: ...


def learn(df: DataFrame, parameter: Parameter, observed: str, value: str, by: Sequence[str] = (), weight: str | None = None, name: str = "parameter") -> DataFrame:
    """One row per key with the parameter's statistics and value."""
    return df.groupBy(*by).agg(*parameter.stats(observed, value, weight)).withColumn(name, parameter.posterior())


# --- statistics -------------------------------------------------------------

def error_counts(observed: str, value: str, weight: str | None = None) -> list[Column]:
    """Errors and matches; missing readings count as neither."""
    one = F.col(weight) if weight else F.lit(1)
    o, v = F.col(observed), F.col(value)
    return [
        F.coalesce(F.sum(F.when(o != v, one)), F.lit(0)).cast("long").alias("errors"),
        F.coalesce(F.sum(F.when(o == v, one)), F.lit(0)).cast("long").alias("matches"),
    ]


def count_errors(df: DataFrame, observed: str, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return df.groupBy(*by).agg(*error_counts(observed, value, weight))


def count_options(df: DataFrame, option: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(option).isNotNull()).groupBy(*by, option).agg(F.count("*").alias("n"))


def gaussian_stats(df: DataFrame, x: str, std: str, by: Sequence[str]) -> DataFrame:
    """Count and sum of readings per noise level."""
    return df.groupBy(*by, std).agg(F.count(x).alias("n"), F.sum(x).alias("sum")).where("n > 0")


def observation_counts(links: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Per entity and column: how many referring records observe it, and the value seen most
    widely agreed on when they agree (the smallest otherwise)."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n_observed"), F.min(c).alias("value")) for c in columns]
    return links.groupBy(entity).agg(F.array(*aggs).alias("_s")).select(entity, F.inline("_s"))


def ref_counts(links: DataFrame, entity: str) -> DataFrame:
    return links.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("n"))


# --- updates ----------------------------------------------------------------

def _with_counts(counts: DataFrame, options: DataFrame, prior: Dirichlet, keys: Sequence[str]) -> DataFrame:
    """(keys, _a): the weight of every option, its own prior weight and how often it was seen."""
    own = F.col(prior.concentration) if isinstance(prior.concentration, str) else F.lit(prior.concentration)
    listed = options.groupBy(*keys).agg(F.max(own).alias("_prior"))
    return listed.join(counts.select(*keys, "n"), list(keys), "left").select(*keys, (F.coalesce(F.col("n"), F.lit(0)) + F.col("_prior")).alias("_a"))


def learn_proportions(counts: DataFrame, options: DataFrame, prior: Dirichlet = Dirichlet(), option: str = "option", by: Sequence[str] = ()) -> DataFrame:
    """Posterior-mean weights; options never seen keep their prior share."""
    keys = [*by, option]
    full = _with_counts(counts, options, prior, keys)
    totals = full.groupBy(*by).agg(F.sum("_a").alias("_t"))
    return with_group(full, by, totals).select(*keys, (F.col("_a") / F.col("_t")).alias("p"))


def learn_error_rate(counts: DataFrame, prior: Beta = Beta(), name: str = "rate") -> DataFrame:
    """Posterior-mean rate from ``errors`` and ``matches``; one row per key of ``counts``."""
    return counts.withColumn(name, prior.posterior())


def _mean_posterior(stats: DataFrame, prior: NormalMean, std: str, by: Sequence[str]) -> DataFrame:
    var = F.col(std) * F.col(std)
    p0 = 1.0 / (prior.spread ** 2)
    return (
        stats.groupBy(*by)
        .agg(F.sum(F.col("sum") / var).alias("_s"), F.sum(F.col("n") / var).alias("_n"), F.sum("n").alias("n"))
        .select(*by, "n", ((F.lit(prior.mean * p0) + F.col("_s")) / (F.lit(p0) + F.col("_n"))).alias("_mean"), (F.lit(p0) + F.col("_n")).alias("_precision"))
    )


def learn_mean(stats: DataFrame, prior: NormalMean, std: str, by: Sequence[str]) -> DataFrame:
    """Posterior mean, each noise level weighted by its precision."""
    return _mean_posterior(stats, prior, std, by).select(*by, "n", F.col("_mean").alias("mean"))


def lookup(df: DataFrame, params: DataFrame, on: Sequence[str], value: str, default: float, weight: Column | str | None = None) -> DataFrame:
    """Parameter of each row's group, or the prior's value for a group not seen.
    ``weight``, the number of rows behind each parameter, lets very large groups be spread; ``params`` should then be
    written, as few enough of them are measured and broadcast, so that the rows stay where they are."""
    if weight is None:
        joined = df.join(params.select(*on, value), list(on), "left")
    else:
        weight = weight if isinstance(weight, Column) else F.col(weight)
        known = params.select(*on, value)
        if is_small(known, FEW_PARAMS):
            no_clash(df, [value])
            joined = with_group(df, on, F.broadcast(known), "left")
        else:
            joined = spread_join(df, params.select(*on, value, weight.alias("_n")).hint("merge"), on, "_n").drop("_n")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def sample_rates(counts: DataFrame, by: str, prior: Beta = Beta(), seed: int = SEED) -> DataFrame:
    """A random draw of each rate's posterior, repeatable per key."""
    rate = draws.beta(prior.a + F.col("errors"), prior.b + F.col("matches"), "rate", F.coalesce(F.col(by).cast("string"), F.lit("")), seed)
    return counts.select(by, rate.alias("rate"))


def sample_proportions(
    counts: DataFrame, options: DataFrame, prior: Dirichlet = Dirichlet(), option: str = "option", by: Sequence[str] = (), seed: int = SEED
) -> DataFrame:
    """A random draw of each group's weights: gamma draws of all options, divided by their sum."""
    keys = [*by, option]
    drawn = _with_counts(counts, options, prior, keys).withColumn("_g", draws.gamma("_a", "share", key_hash(*keys), seed))
    totals = drawn.groupBy(*by).agg(F.sum("_g").alias("_t"))
    return with_group(drawn, by, totals).select(*keys, (F.col("_g") / F.col("_t")).alias("p"))


def sample_means(stats: DataFrame, prior: NormalMean, std: str, by: Sequence[str], seed: int = SEED) -> DataFrame:
    """A random draw of each mean's posterior, each noise level weighted by its precision."""
    key = key_hash(*by) if by else F.lit("")
    return _mean_posterior(stats, prior, std, by).select(*by, "n", (F.col("_mean") + F.sqrt(1 / F.col("_precision")) * draws.normal("mean", key, seed)).alias("mean"))


# --- entity-count prior -------------------------------------------------------

def py_scores(
    refs: DataFrame, strengths: Sequence[float], discounts: Sequence[float], n: str = "n", first_index: int = 0
) -> DataFrame:
    """Pitman-Yor log-score of a clustering for every (strength, discount) of a small grid.

    Closed form: clusters are first counted by size, so the grid only ever meets the
    few distinct sizes, and ln Gamma replaces sums over each cluster's members.
    """
    sizes = refs.groupBy(n).agg(F.count("*").alias("_m"))
    s, d = F.col("strength"), F.col("discount")
    per_size = F.col("_m") * (ln_gamma(F.col(n) - d) - ln_gamma(1 - d))
    totals = (
        sizes.select("*", F.explode(F.array(*[F.lit(float(x)) for x in strengths])).alias("strength"))
        .select("*", F.explode(F.array(*[F.lit(float(x)) for x in discounts])).alias("discount"))
        .groupBy("strength", "discount")
        .agg(
            F.sum(per_size).alias("_inner"),
            F.sum("_m").alias("_k"),
            F.sum(F.col(n) * F.col("_m")).alias("_n"),
        )
    )
    k, total = F.col("_k"), F.col("_n")
    shift = F.lit(float(first_index))
    ratio = s / F.when(d > 0, d) + shift
    opened = F.when(d > 0, k * safe_ln(d) + ln_gamma(k + ratio) - ln_gamma(ratio)).otherwise(k * F.ln(s))
    score = opened + F.col("_inner") - (ln_gamma(total + s) - ln_gamma(s))
    return totals.select("strength", "discount", score.alias("score"))


def learn_py(refs: DataFrame, strengths: Sequence[float], discounts: Sequence[float]) -> DataFrame:
    """The grid's best (strength, discount), flat prior."""
    return best(py_scores(refs, strengths, discounts), [], "score", ["strength", "discount"])
