"""Cleaning jobs a user calls."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablemend.functions.expr import owner_rate, r6, safe_ln
from tablemend.functions.units import Transform, best_unit
from tablemend.operators.choose import best
from tablemend.operators.learn import Beta, NormalMean, count_errors, gaussian_stats, learn_error_rate, learn_mean, lookup
from tablemend.operators.link import LinkModel, link, name_options, on_tuple, seed_entities, sweep, sweep_learned, tuples
from tablemend.operators.spread import no_clash, spread_join
from tablemend.session import Versions, cut_lineage, merge_if_large, scratch


# --- conflicting sources --------------------------------------------------------

def count_claims(claims: DataFrame, entity: Sequence[str], claim: str = "claim", source: str | None = "source") -> DataFrame:
    """Claims by (entity, source, option): all the later rounds ever look at.
    Missing claims say nothing, and claims about no entity decide nothing."""
    keys = [*entity, source] if source else list(entity)
    known = claims
    for c in (*entity, claim):
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*keys, F.col(claim).alias("option")).agg(F.count("*").alias("n"))


def evidence(counts: DataFrame, entity: Sequence[str], rate: Column) -> DataFrame:
    """Summed swap log-likelihood of every (entity, option), options being the values claimed.

    A claim adds ``ln(rate) - ln(m)`` to all m options of its entity, and the difference to
    ``ln(1 - rate)`` to its own option only.  Summing the two parts separately replaces the
    claims x options product by two aggregates, however large an entity is.  The first one,
    already as small as the answer, is written once and read by everything after it.
    """
    miss, hit = safe_ln(rate), safe_ln(1 - rate)
    n = F.col("n")
    own = cut_lineage(
        counts.groupBy(*entity, "option").agg(
            F.sum(n).alias("_n"), F.sum(n * (hit - miss)).alias("_own"), F.sum(n * miss).alias("_base")
        )
    )
    whole = own.groupBy(*entity).agg(F.count("*").alias("n_options"), F.sum("_n").alias("_claims"), F.sum("_base").alias("_all"))
    ln_m = F.ln(F.col("n_options").cast("double"))
    loglik = F.col("_all") + F.col("_own") + ln_m * (F.col("_n") - F.col("_claims"))
    return own.join(whole, list(entity)).select(
        *entity, "option", "n_options", F.col("_claims").alias("n_claims"), loglik.alias("loglik")
    )


def choose_truth(scored: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Best option per entity under a uniform prior, with its posterior.

    Both the choice and the normaliser come from aggregates with map-side combining, so an
    entity with very many options is never gathered in one place.
    """
    score = F.col("loglik") - F.ln(F.col("n_options").cast("double"))
    ranked = scored.select(*entity, "option", "n_claims", score.alias("score"))
    order = F.struct((-r6("score")).alias("rank"), "option")
    top = ranked.groupBy(*entity).agg(F.min_by(F.struct("option", "score"), order).alias("_b"), F.max("score").alias("_m"))
    spread = ranked.join(top, list(entity)).groupBy(*entity).agg(
        F.max("_b").alias("_b"), F.max("_m").alias("_m"), F.max("n_claims").alias("n_claims"), F.sum(F.exp(F.col("score") - F.col("_m"))).alias("_s")
    )
    posterior = F.exp(F.col("_b.score") - F.col("_m")) / F.col("_s")
    return spread.select(*entity, F.col("_b.option").alias("value"), posterior.alias("posterior"), "n_claims")


def truth_discovery(claims: DataFrame, entity: Sequence[str], claim: str = "claim", rate: float = 0.1) -> DataFrame:
    """Consensus of conflicting claims when every source errs equally often."""
    counts = count_claims(claims, entity, claim, None)
    return choose_truth(evidence(counts, entity, F.lit(rate)), entity).drop("n_claims")


def truth_discovery_em(
    claims: DataFrame,
    entity: Sequence[str],
    claim: str = "claim",
    source: str = "source",
    rounds: int = 2,
    prior: Beta = Beta(10.0, 50.0),
    owns: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Consensus and per-source error rates, re-estimated in turn.

    Returns (entity, value, posterior) and (source, errors, matches, rate).  ``owns`` says,
    from the entity and source columns, that the source is the entity's own and trusted.
    """
    counts = cut_lineage(count_claims(claims, entity, claim, source))
    rates = None
    for i in range(rounds):
        rated = counts.withColumn("rate", F.lit(prior.mean)) if rates is None else lookup(
            counts, rates, [source], "rate", prior.mean, F.col("errors") + F.col("matches")
        )
        rate = F.col("rate") if owns is None else owner_rate(owns, "rate")
        truth = choose_truth(evidence(rated, entity, rate), entity)
        truth = truth if i == rounds - 1 else cut_lineage(truth)
        judged = spread_join(counts, truth.select(*entity, "value", "n_claims"), entity, "n_claims", "inner")
        if owns is not None:
            judged = judged.where(~owns)
        rates = learn_error_rate(count_errors(judged, "option", "value", [source], "n"), prior)
        rates = rates if i == rounds - 1 else cut_lineage(rates)
    return truth.drop("n_claims"), rates


# --- typos ------------------------------------------------------------------------

def repair_typos(
    records: DataFrame, column: str, within: Sequence[str] = (), *, max_typos: int, out: str = "repaired", score: str = "score", **model
) -> DataFrame:
    """Adds ``out`` and ``score``: each value read as a mistyped one of the column's own well supported values.

    ``within`` names columns the two must share.  Missing values stay missing.  A value with no
    well supported one within ``max_typos`` stays as it is, with a missing score
    (``without_candidate`` counts those).  For a second column, name both results anew.
    """
    no_clash(records, [out, score])
    m = LinkModel(column, tuple(within), max_typos, **model)
    tups = cut_lineage(tuples(records, m))
    survivors = cut_lineage(seed_entities(tups, m))
    names = survivors.select("entity_id", F.col(column).alias("repaired"))
    decided = link(tups, survivors, m).join(names, "entity_id", "left")
    # Written, as the join with the records reads it three times.
    fixed = cut_lineage(decided.select(*m.fields, "c", F.coalesce("repaired", column).alias(out), F.col("score").alias(score)))
    return on_tuple(records, merge_if_large(fixed), m)


def without_candidate(repaired: DataFrame, column: str, score: str = "score") -> DataFrame:
    """How many values (``n_values``) in how many rows (``n_rows``) of a repaired column had no candidate."""
    left = repaired.where(F.col(column).isNotNull() & F.col(score).isNull())
    return left.groupBy(column).agg(F.count("*").alias("_n")).agg(F.count("*").alias("n_values"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"))


# --- missing cells ------------------------------------------------------------------

def impute(records: DataFrame, column: str, group: Sequence[str], out: str | None = None) -> DataFrame:
    """Fill missing cells with their group's likeliest option, else with the likeliest overall.  Rows whose
    group is missing are a group too."""
    seen = records.where(F.col(column).isNotNull()).groupBy(*group, F.col(column).alias("option")).agg(F.count("*").cast("double").alias("n"))
    overall = best(seen.groupBy("option").agg(F.sum("n").alias("n")), [], "n", ["option"], ["option"])
    sizes = records.groupBy(*group).agg(F.count("*").alias("_rows"))
    found = best(seen, list(group), "n", ["option"], ["option"]).withColumnRenamed("option", "_local")
    # Every group has its row here, one without a shown value and the one of missing keys too, so that all
    # large groups are known to the join with the records.
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"s.`{g}`").eqNullSafe(F.col(f"f.`{g}`"))
    local = cut_lineage(sizes.alias("s").join(found.alias("f"), same, "left").select("s.*", "f._local"))
    filled = F.coalesce(F.col(column), F.col("_local"), overall.select("option").scalar())
    return (
        spread_join(records, local, list(group), "_rows")
        .drop("_rows")
        .withColumn("was_missing", F.col(column).isNull())
        .withColumn(out or column, filled)
        .drop("_local")
    )


# --- units ----------------------------------------------------------------------------

def unit_correct(
    readings: DataFrame,
    x: str,
    group: Sequence[str],
    units: Sequence[Transform],
    prior: NormalMean,
    std: float,
    rounds: int = 2,
    digits: int = 0,
) -> DataFrame:
    """Adds ``unit`` and ``corrected``: the unit each reading is most likely shown in, given its
    group's typical value, which is learned from the readings converted back."""
    placed = readings.withColumn("mean", F.lit(prior.mean))
    for i in range(rounds):
        chosen = placed.withColumn("_u", best_unit(x, F.col("mean"), F.lit(std), units))
        if i == rounds - 1:
            break
        base = chosen.select(*group, F.col("_u.base").alias("base"), F.lit(std).alias("std"))
        means = cut_lineage(learn_mean(gaussian_stats(base, "base", "std", group), prior, "std", group))
        placed = lookup(readings, means, group, "mean", prior.mean, "n")
    return chosen.select(
        *readings.columns, F.col("_u.unit").alias("unit"), F.bround(F.col("_u.base"), digits).alias("corrected"), "mean"
    )


# --- entity tables ----------------------------------------------------------------------

def initial_links(records: DataFrame, m: LinkModel) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tuples, links, entities): the first clustering of all records."""
    tups = cut_lineage(tuples(records, m))
    seeds = cut_lineage(seed_entities(tups, m))
    links = link(tups, seeds, m).select(*m.fields, "c", "entity_id", "is_new")
    return tups, cut_lineage(links), seeds


def sweeps(records: DataFrame, m: LinkModel, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(links, entities) after ``rounds`` sweeps."""
    tups, links, entities = initial_links(records, m)
    for _ in range(rounds):
        links, entities = sweep(tups, links, m)
    return links, entities


@dataclass
class Swept:
    links: DataFrame  # tuples, c, entity_id, is_new, score
    entities: DataFrame  # those referred to, with n
    model: LinkModel  # with the entity-count prior learned last
    progress: list[dict]  # a row per sweep, counted while its links were written


def sweeps_learned(
    records: DataFrame, m: LinkModel, rounds: int, strengths: Sequence[float] = (0.5, 1.0, 2.0, 4.0), discounts: Sequence[float] = (0.0, 0.25, 0.5)
) -> Swept:
    """``rounds`` full sweeps: entities, parameters, then links with the new-entity branch scored.

    Every version of the state is written whole and then replaces the one before; all else that a sweep writes
    is dropped at its end, so lineage and disk stay as they are after the first.
    """
    spark = records.sparkSession
    versions, progress, learned = Versions(spark), [], m
    with scratch(spark):
        tups, links, seeds = initial_links(records, m)
        state = versions.commit(tups=tups, links=links.withColumn("score", F.lit(None).cast("double")), entities=seeds)
        state |= versions.commit(spread=name_options(state["tups"], m))
    for i in range(rounds):
        seen = Observation()
        with scratch(spark):
            links, entities, learned = sweep_learned(state["tups"], state["links"], m, strengths, discounts, state["spread"])
            watched = links.observe(
                seen, F.count(F.lit(1)).alias("tuples"), F.coalesce(F.sum("c"), F.lit(0)).alias("records"),
                F.coalesce(F.sum(F.when(F.col("is_new"), F.col("c"))), F.lit(0)).alias("opened"), F.coalesce(F.sum(F.col("score") * F.col("c")), F.lit(0.0)).alias("score"),
            )
            state |= versions.commit(links=watched)
            referred = entities.join(state["links"].select("entity_id"), "entity_id", "left_semi")
            state |= versions.commit(entities=referred)
        progress.append({"sweep": i + 1, "strength": learned.strength, "discount": learned.discount, **seen.get})
    versions.drop("spread")
    return Swept(state["links"], state["entities"], learned, progress)


def repaired_fields(records: DataFrame, links: DataFrame, entities: DataFrame, m: LinkModel) -> DataFrame:
    """Records with the linked entity's fields in place of their own; a record that opened
    an entity keeps its own values."""
    attrs = entities.select("entity_id", *[F.col(c).alias(f"_{c}") for c in m.fields])
    decided = links.join(attrs, "entity_id", "left").select(*m.fields, "c", "entity_id", *[f"_{c}" for c in m.fields])
    joined = on_tuple(records, decided, m)
    for c in m.fields:
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c))
    return joined.drop(*[f"_{c}" for c in m.fields])
