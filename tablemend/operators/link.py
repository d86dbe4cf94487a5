"""Linking records to entities.

Records are first reduced to distinct tuples of observed values, so that copies cost
nothing; tuples meet entities through the typo pairs of their naming column; the
decision is joined back to the records at the end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions import loglik
from tablemend.functions.expr import key_hash, ln_gamma, r6
from tablemend.operators.candidates import by_segments, few
from tablemend.operators.choose import best, log_sum_exp, top_k
from tablemend.operators.consensus import consensus
from tablemend.operators.domains import letter_bigrams, text_prior
from tablemend.operators.learn import learn_proportions, learn_py
from tablemend.operators.spread import no_clash, spread_join
from tablemend.session import cut_lineage, merge_if_large


@dataclass(frozen=True)
class LinkModel:
    """How a record shows an entity: one naming column read with typos, other columns read as they are.

    The same column names are used on both sides; ``exact`` columns may be missing in a record.
    Values may have any length: the usual ones are ``min_length`` to ``max_length`` letters, and each
    letter beyond halves a value's prior probability.
    """

    name: str
    exact: tuple[str, ...] = ()
    max_typos: int = 2
    min_length: int = 3
    max_length: int = 30
    strength: float = 1.0
    discount: float = 0.25

    def __post_init__(self):
        taken = {"c", "n", "own", "logp", "entity_id", "score", "loglik", "is_new"} & set(self.fields)
        if taken:
            raise ValueError(f"rename {sorted(taken)}: linking adds columns of these names")

    @property
    def fields(self) -> list[str]:
        return [self.name, *self.exact]

    def entity_id(self):
        return key_hash(*[F.coalesce(F.col(c), F.lit("")) for c in self.fields]).alias("entity_id")


def tuples(records: DataFrame, m: LinkModel) -> DataFrame:
    """Distinct observed tuples with their number of copies."""
    return records.groupBy(*m.fields).agg(F.count("*").alias("c"))


def typo_pairs(observed: DataFrame, words: DataFrame, max_typos: int, on: Sequence[str] = ()) -> DataFrame:
    """(observed, word, k, loglik) for distinct pairs within the bound, each scored once.
    ``on`` names columns both sides must agree on.  Both sides are measured, so they should be cheap to read.
    """
    return scored_pairs(by_segments(observed, words, max_typos, on, few(observed, words, max_typos)), max_typos)


def scored_pairs(pairs: DataFrame, max_typos: int) -> DataFrame:
    return pairs.withColumn("loglik", loglik.typos("k", "observed", "word", max_typos))


def scored_candidates(tups: DataFrame, entities: DataFrame, m: LinkModel, pairs: DataFrame | None = None, total: Column | None = None) -> DataFrame:
    """(tuple, entity_id, loglik, score): all acceptable entities of each tuple.

    ``entities`` carries entity_id, the model's fields and ``n`` references.  A caller that keeps an index passes the
    scored ``pairs`` it found there; ``entities`` may then be those they name, and ``total`` the references of all.
    """
    if pairs is None:
        pairs = typo_pairs(tups.select(F.col(m.name).alias("observed")), entities.select(F.col(m.name).alias("word")), m.max_typos)
    t, e = tups.alias("t"), entities.alias("e")
    met = t.join(pairs.alias("p"), F.col(f"t.{m.name}") == F.col("p.observed"))
    cond = F.col("p.word") == F.col(f"e.{m.name}")
    for c in m.exact:
        cond = cond & (F.col(f"t.{c}").isNull() | (F.col(f"t.{c}") == F.col(f"e.{c}")))
    total = entities.select(F.sum("n")).scalar() if total is None else total
    return met.join(e, cond).select(
        "t.*",
        "e.entity_id",
        *[F.col(f"e.{c}").alias(f"e_{c}") for c in m.fields],
        F.col("p.loglik"),
        (loglik.link_existing("e.n", total, F.lit(m.strength), F.lit(m.discount)) + F.col("p.loglik")).alias("score"),
    )


def on_tuple(records: DataFrame, decided: DataFrame, m: LinkModel, how: str = "left") -> DataFrame:
    """Bring a decision made per tuple back to the records.  Where the decision still knows
    the tuple's number of copies ``c``, tuples with very many are kept from one task."""
    if "c" in decided.columns:
        return spread_join(records, decided.withColumnRenamed("c", "_copies"), m.fields, "_copies", how).drop("_copies")
    new = [c for c in decided.columns if c not in m.fields]
    no_clash(records, new)
    cond = None
    for c in m.fields:
        same = F.col(f"r.`{c}`").eqNullSafe(F.col(f"d.`{c}`"))
        cond = same if cond is None else cond & same
    return records.alias("r").join(decided.alias("d"), cond, how).select("r.*", *[F.col(f"d.`{c}`") for c in new])


def name_prior(tups: DataFrame, m: LinkModel) -> DataFrame:
    """Letter-model log-probability of each distinct observed name."""
    texts = tups.where(F.col(m.name).isNotNull()).groupBy(F.col(m.name).alias("word")).agg(F.sum("c").alias("c"))
    letters = letter_bigrams(texts, "word", "c")
    return text_prior(texts.select("word"), letters, m.min_length, m.max_length, tails=True)


def seed_entities(tups: DataFrame, m: LinkModel) -> DataFrame:
    """Decide which distinct tuples stand for entities of their own.

    A tuple with c copies either opens an entity (paying the letter model's price of its
    name once, and joining it c-1 times) or joins, with all its copies, a better supported
    tuple within the typo bound.  Support orders the tuples, so no two can join each other.
    """
    seeds = tups
    for c in m.fields:
        seeds = seeds.where(F.col(c).isNotNull())
    seeds = seeds.select(m.entity_id(), *m.fields, F.col("c").alias("n"))
    d = F.lit(m.discount)
    n_seeds = seeds.select(F.count("*")).scalar()
    own = F.ln(n_seeds * m.discount + m.strength) + F.col("logp") + F.col("n") * F.col("_self") + ln_gamma(F.col("n") - d) - ln_gamma(1 - d)
    for c in m.exact:
        own = own - F.ln(seeds.select(F.count_distinct(c)).scalar().cast("double"))
    priced = cut_lineage(
        merge_if_large(seeds).join(name_prior(tups, m).withColumnRenamed("word", m.name), m.name)
        .withColumn("_self", loglik.typos(F.lit(0), m.name, m.name))
        .withColumn("own", own)
        .select("entity_id", *m.fields, "n", "own")
    )
    # One better supported tuple that wins is enough to decide.  Nearly all mistyped tuples lose to one of the few that
    # most records show (a record's tuple has ``usual`` copies on average, and at most 8 * total / usual tuples have an
    # eighth of that), so only the undecided ones meet those of more than average support, and what is left the rest.
    n = F.col("n").cast("double")
    seen = priced.agg(F.avg(n).alias("average"), (F.sum(n * n) / F.sum(n)).alias("usual")).first()
    average = seen["average"] or 0.0
    much = max((seen["usual"] or 0.0) / 8, average)
    undecided = priced
    for rivals in (F.col("n") >= much, (F.col("n") >= average) & (F.col("n") < much)):
        undecided = cut_lineage(_without_losers(undecided, priced.where(rivals), m))
    return _without_losers(undecided, priced.where(F.col("n") < average), m).select("entity_id", *m.fields, "n")


def _without_losers(seeds: DataFrame, rivals: DataFrame, m: LinkModel) -> DataFrame:
    """Seeds that would not rather join one of the better supported ``rivals``."""
    d = F.lit(m.discount)
    shared = [f"_x{i}" for i in range(len(m.exact))]
    blocks = [F.col(c).alias(x) for c, x in zip(m.exact, shared)]
    observed = seeds.select(*blocks, F.col(m.name).alias("observed"))
    pairs = typo_pairs(observed, rivals.select(*blocks, F.col(m.name).alias("word")), m.max_typos, shared).where("k > 0")
    w, v = merge_if_large(seeds).alias("w"), merge_if_large(rivals).alias("v")

    def same(side: str, column: str):
        cond = F.col(f"p.{column}") == F.col(f"{side}.{m.name}")
        for c, x in zip(m.exact, shared):
            cond = cond & (F.col(f"p.{x}") == F.col(f"{side}.{c}"))
        return cond

    stronger = (F.col("v.n") > F.col("w.n")) | ((F.col("v.n") == F.col("w.n")) & (F.col("v.entity_id") < F.col("w.entity_id")))
    joining = F.col("w.n") * F.col("p.loglik") + ln_gamma(F.col("v.n") + F.col("w.n") - d) - ln_gamma(F.col("v.n") - d)
    losers = (
        w.join(pairs.alias("p"), same("w", "observed"))
        .join(v, same("v", "word") & stronger)
        .where(r6(joining) > r6("w.own"))
        .select("w.entity_id")
    )
    return seeds.join(losers, "entity_id", "left_anti")


def merge_new(opened: DataFrame, m: LinkModel) -> DataFrame:
    """(fields, c, old_id, entity_id): new entities that are spellings of one another become one.

    ``opened`` has the tuples that opened entities, with their copies ``c``.  A tuple joins a better supported one within the
    typo bound only if that raises the score of the whole clustering over keeping an entity of its own; what
    remains links to the likeliest that is left.
    """
    tups = cut_lineage(opened.groupBy(*m.fields).agg(F.sum("c").alias("c")))
    kept = cut_lineage(seed_entities(tups, m))
    return link(tups, kept, m).select(*m.fields, "c", m.entity_id().alias("old_id"), "entity_id")


def link_staged(candidates: DataFrame, entities: DataFrame, m: LinkModel, block: str, beam: int, strength: float, discount: float) -> DataFrame:
    """Best candidate of each tuple when its ``block`` is decided first: (fields, e_* fields, score).

    The score adds the block's prior.  A tuple without block looks into the ``beam`` likeliest
    blocks only, and into all of them if those hold no candidate of its own.
    """
    sizes = entities.groupBy(block).agg(F.sum("n").alias("n"))
    total = sizes.select(F.sum("n")).scalar()
    priced = cut_lineage(sizes.select(F.col(block).alias("_block"), loglik.link_existing("n", total, F.lit(strength), F.lit(discount)).alias("_prior")))
    likely = top_k(priced.withColumn("_all", F.lit(0)), ["_all"], "_prior", ["_block"], beam).select("_block", F.lit(True).alias("_likely"))
    priced = priced.join(likely, "_block", "left")
    met = candidates.join(priced, F.col(f"e_{block}") == F.col("_block"))
    met = met.withColumn("_outside", F.col(block).isNull() & F.col("_likely").isNull()).withColumn("score", F.col("score") + F.col("_prior"))
    shown = [f"e_{c}" for c in m.fields]
    picked = best(met, [*m.fields, "_outside"], "score", [f"e_{m.name}"], [*shown, "score"])
    return best(picked.withColumn("_in", F.when(F.col("_outside"), 0.0).otherwise(1.0)), m.fields, "_in", [f"e_{m.name}"], [*shown, "score"])


def link(tups: DataFrame, entities: DataFrame, m: LinkModel, pairs: DataFrame | None = None, total: Column | None = None) -> DataFrame:
    """Best existing entity of each tuple; a tuple without any becomes a new entity itself.  ``pairs`` and ``total`` as in
    :func:`scored_candidates`."""
    chosen = best(scored_candidates(tups, entities, m, pairs, total), m.fields, "score", ["entity_id"], ["entity_id", "score"])
    decided = on_tuple(tups, chosen, m)
    own = m.entity_id()
    return decided.withColumn("is_new", F.col("entity_id").isNull()).withColumn("entity_id", F.coalesce("entity_id", own))


def name_options(tups: DataFrame, m: LinkModel) -> DataFrame:
    """(name, lse): each observed name summed over all names it may be mistyped from (letter prior + typo likelihood).
    It depends on the observed tuples alone, so rounds over the same tuples share it, written."""
    words = cut_lineage(name_prior(tups, m))
    pairs = typo_pairs(tups.select(F.col(m.name).alias("observed")), words.select("word"), m.max_typos)
    # Written, as the sum reads them twice and finding them is most of the work.
    options = cut_lineage(pairs.join(words, "word").select("observed", (F.col("logp") + F.col("loglik")).alias("x")))
    return log_sum_exp(options, ["observed"], "x").withColumnRenamed("observed", m.name)


def relink(
    tups: DataFrame, entities: DataFrame, m: LinkModel, weights: Mapping[str, DataFrame] | None = None, spread: DataFrame | None = None
) -> DataFrame:
    """As ``link``, with the new-entity branch scored too.

    The new branch sums, per field, over the field's options (letter prior + typo
    likelihood); fields add up, so options are never combined across fields.  ``weights`` has
    (option, p) for exact columns whose options are not all equally likely.  A caller that has them passes the
    ``name_options`` of the tuples as ``spread``.
    """
    existing = scored_candidates(tups, entities, m)
    spread = name_options(tups, m) if spread is None else spread
    total = entities.select(F.sum("n")).scalar()
    n_entities = entities.select(F.count("*")).scalar()
    score = loglik.link_new(n_entities, total, F.lit(m.strength), F.lit(m.discount)) + F.col("lse")
    options_of = tups.join(spread, m.name)
    for i, c in enumerate(m.exact):
        n_options = F.ln(tups.select(F.count_distinct(c)).scalar().cast("double"))
        if weights and c in weights:
            options_of = options_of.join(weights[c].select(F.col("option").alias(c), F.ln("p").alias(f"_w{i}")), c, "left")
            n_options = F.coalesce(-F.col(f"_w{i}"), n_options)
        score = score - F.when(F.col(c).isNotNull(), n_options).otherwise(0.0)
    opened = options_of.select(*m.fields, m.entity_id(), score.alias("score"), F.lit(True).alias("is_new"))
    both = existing.select(*m.fields, "entity_id", "score", F.lit(False).alias("is_new")).unionByName(opened)
    return on_tuple(tups, best(both, m.fields, "score", ["is_new", "entity_id"]), m)


def reestimate(links: DataFrame, m: LinkModel) -> DataFrame:
    """Entity attributes from all records linked to them.

    ``links`` has the observed tuple, its copies ``c`` and ``entity_id``.  The name is the consensus of those
    shown.  Exact columns take their most frequent value.  Entities that end up equal share one id.
    """
    named = links.where(F.col(m.name).isNotNull()).groupBy("entity_id", F.col(m.name).alias("observed")).agg(F.sum("c").alias("c"))
    out = consensus(named, m.max_typos).withColumnRenamed("word", m.name)
    for column in m.exact:
        votes = links.where(F.col(column).isNotNull()).groupBy("entity_id", column).agg(F.sum("c").cast("double").alias("score"))
        out = out.join(best(votes, ["entity_id"], "score", [column], [column]), "entity_id", "left")
    return out.withColumnRenamed("entity_id", "old_id").withColumn("entity_id", m.entity_id())


def learn_model(entities: DataFrame, tups: DataFrame, m: LinkModel, strengths: Sequence[float], discounts: Sequence[float]) -> tuple[LinkModel, dict[str, DataFrame]]:
    """What the entities of a round say about the model: the entity-count prior, from how many references each
    has, and the weights of the exact columns' options, from the references to entities that show them."""
    grid = learn_py(entities.select("n"), strengths, discounts).first()
    weights = {}
    for c in m.exact:
        counts = entities.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("option")).agg(F.sum("n").alias("n"))
        options = tups.where(F.col(c).isNotNull()).select(F.col(c).alias("option")).distinct()
        weights[c] = cut_lineage(learn_proportions(counts, options))
    return replace(m, strength=grid["strength"], discount=grid["discount"]), weights


def sweep_learned(
    tups: DataFrame, links: DataFrame, m: LinkModel, strengths: Sequence[float], discounts: Sequence[float], spread: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, LinkModel]:
    """One full round: entities from their records, parameters from the entities, then every record against all entities
    and a new one.  Returns links (with ``score``), the entities found and the learned model.  A tuple
    without a name keeps an entity of its own.  ``spread`` as in :func:`relink`."""
    sizes = links.groupBy(F.col("entity_id").alias("old_id")).agg(F.sum("c").alias("n"))
    entities = cut_lineage(reestimate(links, m).join(sizes, "old_id").groupBy("entity_id", *m.fields).agg(F.sum("n").alias("n")))
    learned, weights = learn_model(entities, tups, m, strengths, discounts)
    decided = relink(tups, entities, learned, weights, spread)
    own = m.entity_id()
    return (
        decided.select(*m.fields, "c", F.coalesce("entity_id", own).alias("entity_id"), F.coalesce("is_new", F.lit(True)).alias("is_new"), "score"),
        entities,
        learned,
    )


def sweep(tups: DataFrame, links: DataFrame, m: LinkModel) -> tuple[DataFrame, DataFrame]:
    """One round: entities from their records, then records against the entities.
    Returns the new links and the entities still referred to; each version is written
    before anything reads it, so lineage stays one round deep."""
    renamed = reestimate(links, m)
    sizes = links.groupBy(F.col("entity_id").alias("old_id")).agg(F.sum("c").alias("n"))
    entities = cut_lineage(renamed.join(sizes, "old_id").groupBy("entity_id", *m.fields).agg(F.sum("n").alias("n")))
    new_links = cut_lineage(link(tups, entities, m).select(*m.fields, "c", "entity_id", "is_new"))
    return new_links, entities.join(new_links.select("entity_id"), "entity_id", "left_semi")
