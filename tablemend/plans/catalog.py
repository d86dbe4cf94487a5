"""The query catalogue: one callable per operator, over a star schema's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.functions import loglik, models
from tablemend.functions.expr import approx_equal, blocking_key, is_abbreviation, is_time, owner_rate, r6, uniform
from tablemend.functions.units import IDENTITY, THOUSANDS, best_unit
from tablemend.operators import candidates, choose, domains, evaluate, inject, learn, link, prepare, score, state
from tablemend.plans import fixtures as fx
from tablemend.operators.spread import attach
from tablemend.plans import declared, jobs, nested
from tablemend.plans.model import Column, EntityClass, clean
from tablemend.session import cut_lineage, scratch_path
from tablemend.sources import sinks, tables
from tablemend.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NATION = link.LinkModel("nation", ("region",))
UNITS = (IDENTITY, THOUSANDS)
RATE = learn.Beta(10.0, 50.0)
STRENGTHS, DISCOUNTS = (0.5, 1.0, 2.0, 4.0, 8.0), (0.0, 0.25, 0.5)


def query(f: Query | None = None, name: str | None = None):
    """Register a query under its function's name, or another where that name is an import's."""

    def add(g: Query) -> Query:
        QUERIES[name or g.__name__] = g
        return g

    return add(f) if f else add


# --- reading and preparing ---------------------------------------------------------

@query
def scan_table(spark, d):
    return fx.table(spark, d, "customer")


@query
def bind_observed(spark, d):
    return tables.bind_observed(fx.table(spark, d, "customer"), ["c_custkey"])


@query
def multi_dataset(spark, d):
    c = tables.bind_observed(fx.table(spark, d, "customer"), ["c_custkey"])
    s = tables.bind_observed(fx.table(spark, d, "supplier"), ["s_suppkey"])
    return tables.combine({
        "customer": c.select("row_id", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
                             F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")),
        "supplier": s.select("row_id", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal")),
    })


@query
def align_columns(spark, d):
    raw = fx.parts_dirty(spark, d).withColumnRenamed("p_name", "Part Name")
    return prepare.align_columns(raw, {"Part Name": ("name", "name_obs"), "p_type": "type"})


@query
def ref_lookup(spark, d):
    nation = fx.table(spark, d, "nation")
    cust = fx.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return prepare.follow(cust, [(nation, "c_nationkey", "n_nationkey", {"n_name": "n_name"})]).select("c_custkey", "n_name")


def _customer_path(spark, d, *extra):
    return prepare.follow(fx.table(spark, d, "customer").select("c_custkey", "c_nationkey", *extra), [
        (fx.table(spark, d, "nation"), "c_nationkey", "n_nationkey", {"n_name": "n_name", "n_regionkey": "n_regionkey"}),
        (fx.table(spark, d, "region"), "n_regionkey", "r_regionkey", {"r_name": "r_name"}),
    ])


@query
def ref_path(spark, d):
    return _customer_path(spark, d).select("c_custkey", "n_name", "r_name")


@query
def derived_column(spark, d):
    return _customer_path(spark, d, "c_mktsegment", "c_acctbal").select(
        "c_custkey", F.concat_ws("_", "r_name", "c_mktsegment").alias("r_name_segment"), F.bround("c_acctbal", 0).alias("balance")
    )


@query(name="blocking_key")
def blocking_keys(spark, d):
    return fx.parts_dirty(spark, d).select("row_id", blocking_key("p_name").alias("key"))


@query
def type_align(spark, d):
    keys = fx.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    as_text = keys.select(*[F.col(c).cast("string").alias(c) for c in keys.columns])
    return prepare.align_types(keys, as_text)


@query
def missing_policy(spark, d):
    return prepare.missing_policy(fx.parts_dirty(spark, d), {"p_name": models.TYPOS, "p_type": None, "p_brand": None})


@query(name="approx_equal")
def approx_equality(spark, d):
    p = fx.prices(spark, d)
    return p.select("row_id", approx_equal("noisy", "shown").alias("same"),
                    approx_equal(F.col("noisy"), F.col("shown") * 1000).alias("same_in_thousands"))


@query(name="is_abbreviation")
def abbreviation_test(spark, d):
    n = fx.names(spark, d)
    full = F.concat_ws(" ", "first", "middle", "last")
    return n.select("row_id", is_abbreviation(F.replace("shown", F.lit("."), F.lit("")), full).alias("of_full"),
                    is_abbreviation(F.substring("middle", 1, 2), F.col("last")).alias("of_last"))


@query
def time_valid(spark, d):
    return fx.times(spark, d).select("row_id", is_time("time_text").alias("valid"))


@query
def source_override(spark, d):
    owns = F.col("part") % 100 == F.col("source")
    return fx.claims(spark, d).select("row_id", r6(owner_rate(owns, F.lit(RATE.mean))).alias("error_rate"))


# --- domains ---------------------------------------------------------------------------

@query
def domain_global(spark, d):
    return domains.domain(fx.parts_dirty(spark, d), ["p_name", "p_type", "p_brand"])


def _claim_options(spark, d):
    return domains.domain(fx.claims(spark, d), ["claim"], ["part"]).select("part", "option")


@query
def domain_grouped(spark, d):
    return _claim_options(spark, d)


@query
def domain_lookup(spark, d):
    c = cut_lineage(fx.claims(spark, d).select("row_id", "part", F.col("claim").alias("option")))
    priors = domains.uniform_domain(c.select("part", "option").distinct(), ["part"])
    known = attach(c, priors.select("part", "option", "log_prior"), ["part", "option"]).where("log_prior is not null")
    return known.select("row_id", "option", r6("log_prior").alias("log_prior"))


@query
def domain_uniform(spark, d):
    opts = domains.domain(fx.claims(spark, d), ["claim"])
    return domains.uniform_domain(opts).select("option", r6("log_prior").alias("log_prior"))


def _claim_weights(spark, d):
    counts = learn.count_options(fx.claims(spark, d).select(F.col("claim").alias("option")), "option")
    return choose.normalize(cut_lineage(counts), [], "n", "weight")


@query
def domain_weighted(spark, d):
    w = _claim_weights(spark, d)
    return domains.weighted_domain(w.select("option"), w).select("option", r6("log_prior").alias("log_prior"))


@query
def domain_time(spark, d):
    opts = cut_lineage(domains.domain(fx.times(spark, d), ["time_text"]))
    return domains.time_domain(opts).select("option", r6("log_prior").alias("log_prior"), "is_placeholder")


@query
def domain_with_other(spark, d):
    words = domains.domain(fx.parts_dirty(spark, d), ["p_name"]).select(F.col("option").alias("word"))
    priced = cut_lineage(domains.text_prior(words, domains.letter_bigrams(fx.texts(spark, d)), 3, 30))
    scored = priced.select(F.col("word").alias("option"), F.col("logp").alias("log_prior"))
    return domains.with_other(scored, domains.text_placeholder(3, 30)).withColumn("log_prior", r6("log_prior"))


@query
def enumerate_options(spark, d):
    parts = fx.table(spark, d, "part").select(F.col("p_partkey").alias("part"))
    priors = domains.uniform_domain(cut_lineage(_claim_options(spark, d)), ["part"])
    return domains.enumerate_options(parts, priors, ["part"]).select("part", "option", r6("log_prior").alias("log_prior"))


# --- candidates ---------------------------------------------------------------------------

def _tuples(spark, d):
    return link.tuples(fx.customers_flat(spark, d), NATION)


def _named(spark, d):
    return fx.nations(spark, d).select("entity_id", F.col("nation").alias("name"), "region")


@query
def candidates_blocked(spark, d):
    return candidates.blocked(_tuples(spark, d), _named(spark, d), ["region"]).select("nation", "region", "entity_id")


@query
def candidates_constrained(spark, d):
    met = candidates.blocked(_tuples(spark, d), _named(spark, d), ["region"])
    return candidates.constrained(met, [F.col("nation").eqNullSafe(F.col("name"))]).select("nation", "region", "entity_id")


def _name_words(spark, d):
    observed = fx.parts_dirty(spark, d).select(F.col("p_name").alias("observed"))
    return observed, fx.table(spark, d, "part").select(F.col("p_name").alias("word"))


@query
def candidates_unblocked(spark, d):
    return candidates.by_deletion(*_name_words(spark, d), 2).select("observed", "word")


@query
def candidates_qgram(spark, d):
    return candidates.by_segments(*_name_words(spark, d), 2).select("observed", "word")


@query
def edit_distance(spark, d):
    return candidates.by_deletion(*_name_words(spark, d), 2).select("observed", "word", "k")


# --- likelihoods -----------------------------------------------------------------------------

@query
def typo_loglik(spark, d):
    return link.typo_pairs(*_name_words(spark, d), 2).select("observed", "word", r6("loglik").alias("loglik"))


@query
def swap_loglik(spark, d):
    c = cut_lineage(inject.missing(fx.claims(spark, d), "claim", "claim", 0.1).withColumn("rate", F.lit(0.1)))
    opts = domains.domain(c, ["claim"], ["part"])
    return score.score_swap(c, opts, "claim", "truth", ["part"], "rate").select("row_id", r6("loglik").alias("loglik"))


@query
def uniform_loglik(spark, d):
    c = cut_lineage(fx.claims(spark, d).select("row_id", "part", "claim"))
    return score.score_uniform(c, domains.domain(c, ["claim"], ["part"]), ["part"]).select("row_id", r6("loglik").alias("loglik"))


@query
def proportional_loglik(spark, d):
    return score.score_proportional(fx.claims(spark, d), _claim_weights(spark, d), "claim").select("row_id", r6("loglik").alias("loglik"))


@query
def gaussian_loglik(spark, d):
    return fx.prices(spark, d).select("row_id", r6(loglik.gaussian("noisy", "truth", F.lit(10.0))).alias("loglik"))


@query
def unit_loglik(spark, d):
    return score.score_units(fx.prices(spark, d), "shown", "truth", 150.0, UNITS).select("row_id", "unit", r6("loglik").alias("loglik"))


@query
def char_bigram(spark, d):
    return domains.letter_bigrams(fx.texts(spark, d)).withColumn("p", r6("p"))


@query
def string_prior(spark, d):
    words = fx.table(spark, d, "part").select(F.col("p_name").alias("word")).distinct()
    return domains.text_prior(words, domains.letter_bigrams(fx.texts(spark, d)), 3, 30).select("word", r6("logp").alias("logp"))


@query
def time_prior(spark, d):
    return fx.times(spark, d).select("row_id", r6(loglik.time_of_day("time_text")).alias("logp"))


@query
def number_prior(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", r6(loglik.number_code("c_custkey")).alias("logp"))


@query
def name_loglik(spark, d):
    n = inject.missing(fx.names(spark, d), "shown", "shown", 0.1)
    return n.select("row_id", r6(loglik.full_name("shown", "first", "middle", "last")).alias("loglik"))


@query
def initial_loglik(spark, d):
    n = inject.missing(fx.names(spark, d), "shown", "shown", 0.1)
    first = F.split_part("shown", F.lit(" "), F.lit(1))
    return n.select("row_id", r6(loglik.one_name(first, "first")).alias("loglik"))


def _short_names(spark, d):
    second = F.split_part("clean_name", F.lit(" "), F.lit(2))
    short = F.concat(F.substring("clean_name", 1, 1), F.substring(second, 1, 2))
    return fx.parts_dirty(spark, d).select("row_id", short.alias("short"), "clean_name", "p_name")


@query
def abbrev_loglik(spark, d):
    s = _short_names(spark, d)
    pairs = s.select("short", F.col("p_name").alias("observed")).distinct()
    opts = s.select(F.col("clean_name").alias("option")).distinct()
    return score.score_abbreviation(pairs, opts, "observed", "short").select("short", "observed", r6("loglik").alias("loglik"))


# --- sums, posteriors ------------------------------------------------------------------------------

def _option_scores(spark, d):
    counts = jobs.count_claims(fx.claims(spark, d), ["part"], "claim", None)
    scored = jobs.evidence(cut_lineage(counts), ["part"], F.lit(0.1))
    return cut_lineage(scored.select("part", "option", (F.col("loglik") - F.ln(F.col("n_options").cast("double"))).alias("score")))


@query
def logsumexp(spark, d):
    return choose.log_sum_exp(_option_scores(spark, d), ["part"], "score").select("part", r6("lse").alias("lse"))


@query
def normalize_weights(spark, d):
    return _claim_weights(spark, d).select("option", r6("weight").alias("weight"), r6(F.ln("weight")).alias("log_weight"))


@query
def candidate_posterior(spark, d):
    return choose.posterior(_option_scores(spark, d), ["part"], "score").select("part", "option", r6("p").alias("p"))


@query
def link_ambiguity(spark, d):
    p = choose.posterior(_option_scores(spark, d), ["part"], "score")
    return choose.effective_candidates(p, ["part"]).select("part", r6("ess").alias("ess"))


@query
def log_marginal(spark, d):
    return choose.log_sum_exp(_option_scores(spark, d), ["part"], "score").agg(F.round(F.sum("lse"), 4).alias("total"))


# --- counts, parameters ------------------------------------------------------------------------------

def _refs(spark, d):
    return learn.ref_counts(fx.claims(spark, d), "part")


@query
def ref_counts(spark, d):
    refs = cut_lineage(_refs(spark, d))
    return refs.withColumn("total", refs.select(F.sum("n")).scalar())


@query
def py_prior(spark, d):
    refs = cut_lineage(_refs(spark, d))
    s, disc = F.lit(1.0), F.lit(0.25)
    total = refs.select(F.sum("n")).scalar()
    known = refs.select(F.col("part").cast("string").alias("entity"), r6(loglik.link_existing("n", total, s, disc)).alias("logp"))
    new = refs.agg(F.count("*").alias("k"), F.sum("n").alias("t")).select(
        F.lit("new").alias("entity"), r6(loglik.link_new("k", "t", s, disc)).alias("logp"))
    return known.unionByName(new)


@query
def py_score(spark, d):
    return learn.py_scores(_refs(spark, d), STRENGTHS, DISCOUNTS).withColumn("score", F.round("score", 3))


@query
def learn_py_params(spark, d):
    return learn.learn_py(_refs(spark, d), STRENGTHS, DISCOUNTS).withColumn("score", F.round("score", 3))


@query
def observation_counts(spark, d):
    flat = fx.customers_flat(spark, d)
    return learn.observation_counts(flat.withColumnRenamed("true_nation", "entity"), "entity", ["segment", "region"])


@query
def counts_categorical(spark, d):
    return learn.count_options(fx.claims(spark, d).select(F.col("claim").alias("option")), "option")


@query
def learn_proportions(spark, d):
    counts = cut_lineage(learn.count_options(fx.claims(spark, d).select(F.col("claim").alias("option")), "option"))
    options = fx.table(spark, d, "part").select(F.col("p_type").alias("option")).distinct()
    return learn.learn_proportions(counts, options).select("option", r6("p").alias("p"))


@query
def counts_error(spark, d):
    return learn.count_errors(fx.claims(spark, d), "claim", "truth")


@query
def learn_error_rate(spark, d):
    return learn.learn_error_rate(learn.count_errors(fx.claims(spark, d), "claim", "truth")).select(r6("rate").alias("rate"))


def _by_source(spark, d):
    return learn.count_errors(fx.claims(spark, d), "claim", "truth", ["source"])


@query
def counts_error_grouped(spark, d):
    return _by_source(spark, d)


@query
def learn_error_rate_by_source(spark, d):
    return learn.learn_error_rate(_by_source(spark, d), RATE).select("source", r6("rate").alias("rate"))


@query
def param_lookup(spark, d):
    rates = learn.learn_error_rate(_by_source(spark, d), RATE)
    keys = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("source"))
    return learn.lookup(keys, rates, ["source"], "rate", RATE.mean).select("source", r6("rate").alias("rate"))


@query
def stats_gaussian(spark, d):
    p = fx.prices(spark, d).withColumn("std", F.lit(10.0))
    return learn.gaussian_stats(p, "noisy", "std", ["part"]).withColumn("sum", F.round("sum", 4))


@query
def stats_gaussian_units(spark, d):
    p = fx.prices(spark, d)
    base = p.select("part", best_unit("shown", F.col("truth"), F.lit(150.0), UNITS)["base"].alias("base"), F.lit(150.0).alias("std"))
    return learn.gaussian_stats(base, "base", "std", ["part"]).withColumn("sum", F.round("sum", 4))


@query
def learn_mean(spark, d):
    p = fx.prices(spark, d).withColumn("std", F.lit(10.0))
    stats = learn.gaussian_stats(p, "noisy", "std", ["part"])
    return learn.learn_mean(stats, learn.NormalMean(1500.0, 1000.0), "std", ["part"]).select("part", r6("mean").alias("mean"))


@query
def learn_sampled(spark, d):
    """A draw of each source's error rate."""
    return learn.sample_rates(_by_source(spark, d), "source", RATE).select("source", r6("rate").alias("rate"))


@query
def learn_sampled_proportions(spark, d):
    """A draw of each region's market shares, with a prior that favours longer names."""
    flat = fx.customers_flat(spark, d)
    counts = learn.count_options(flat, "true_segment", ["true_region"])
    options = flat.select("true_region", "true_segment", (F.length("true_segment") / 10.0).alias("weight")).distinct()
    drawn = learn.sample_proportions(counts, options, learn.Dirichlet("weight"), "true_segment", ["true_region"])
    return drawn.select("true_region", "true_segment", r6("p").alias("p"))


@query
def learn_sampled_means(spark, d):
    """A draw of each part's mean price."""
    stats = learn.gaussian_stats(fx.prices(spark, d).withColumn("std", F.lit(10.0)), "noisy", "std", ["part"])
    return learn.sample_means(stats, learn.NormalMean(1500.0, 1000.0), "std", ["part"]).select("part", "n", r6("mean").alias("mean"))


# --- truth discovery ----------------------------------------------------------------------------------

def _flags(spark, d):
    return fx.table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("claim"))


@query
def entity_evidence(spark, d):
    counts = jobs.count_claims(_flags(spark, d), ["l_partkey"], "claim", None)
    return jobs.evidence(counts, ["l_partkey"], F.lit(0.1)).select("l_partkey", "option", r6("loglik").alias("loglik"))


@query
def truth_discovery(spark, d):
    return jobs.truth_discovery(_flags(spark, d), ["l_partkey"]).withColumn("posterior", r6("posterior"))


@query
def truth_discovery_em(spark, d):
    truth, _ = jobs.truth_discovery_em(fx.claims(spark, d), ["part"], rounds=2, prior=RATE)
    return truth.withColumn("posterior", r6("posterior"))


@query
def source_rates_em(spark, d):
    owns = F.col("part") % 100 == F.col("source")
    _, rates = jobs.truth_discovery_em(fx.claims(spark, d), ["part"], rounds=2, prior=RATE, owns=owns)
    return rates.withColumn("rate", r6("rate"))


# --- linking -------------------------------------------------------------------------------------------

def _scored(spark, d):
    """Records, their tuples' candidates among the clean nations, scored."""
    flat = cut_lineage(fx.customers_flat(spark, d).select("row_id", "nation", "region"))
    ents = cut_lineage(fx.nations(spark, d, flat))
    return flat, cut_lineage(link.scored_candidates(link.tuples(flat, NATION), ents, NATION)), ents


@query
def link_map(spark, d):
    flat, cand, _ = _scored(spark, d)
    top = choose.best(cand, NATION.fields, "score", ["entity_id"], ["entity_id", "score", "c"])
    return link.on_tuple(flat, top, NATION).select("row_id", "entity_id", r6("score").alias("score"))


@query
def link_topk(spark, d):
    flat, cand, _ = _scored(spark, d)
    top = choose.top_k(cand, NATION.fields, "score", ["entity_id"], 3)
    return link.on_tuple(flat, top, NATION).select("row_id", "rank", "entity_id", r6("score").alias("score"))


def _sampled(flat, cand, tag):
    p = choose.posterior(cand, NATION.fields, "score")
    cdf = choose.cumulative(p, NATION.fields, "p", ["entity_id"])
    return choose.sample(flat, "row_id", cdf.select(*NATION.fields, "entity_id", "score", "lo", "hi"), NATION.fields, tag)


@query
def link_sampled(spark, d):
    flat, cand, _ = _scored(spark, d)
    return _sampled(flat, cand, "link").select("row_id", "entity_id")


@query
def accept_or_keep(spark, d):
    flat, cand, _ = _scored(spark, d)
    top = choose.best(cand, NATION.fields, "score", ["entity_id"], ["entity_id", "score", "c"])
    old = link.on_tuple(flat, top, NATION).select("row_id", F.col("entity_id").alias("old_id"), F.col("score").alias("old_score"))
    new = _sampled(flat, cand, "propose").select("row_id", F.col("entity_id").alias("new_id"), F.col("score").alias("new_score"))
    out = choose.accept_or_keep(old.join(new, "row_id"), "old_score", "new_score", "row_id")
    return out.select("row_id", F.when(F.col("accepted"), F.col("new_id")).otherwise(F.col("old_id")).alias("entity_id"), "accepted")


@query
def link_staged(spark, d):
    flat, cand, ents = _scored(spark, d)
    top = link.link_staged(cand, ents, NATION, "region", 2, 1.0, 0.25)
    out = link.on_tuple(flat.select("row_id", "nation", "region"), top, NATION)
    return out.select("row_id", F.col("e_region").alias("region"), F.col("e_nation").alias("nation"), r6("score").alias("score"))


@query
def initial_link(spark, d):
    flat = cut_lineage(fx.customers_flat(spark, d).select("row_id", "nation", "region"))
    _, links, _ = jobs.initial_links(flat, NATION)
    return link.on_tuple(flat, links, NATION).select("row_id", "entity_id", "is_new")


@query
def new_entities(spark, d):
    flat = cut_lineage(fx.customers_flat(spark, d).select("row_id", "nation", "region"))
    strict = link.LinkModel("nation", ("region",), max_typos=1)
    decided = link.link(link.tuples(flat, strict), fx.nations(spark, d, flat), strict)
    return decided.where("is_new").select("entity_id", "nation", "region", F.col("c").alias("n"))


@query
def merge_new_entities(spark, d):
    """Records of nations that no entity stands for: their spellings end up in one new entity each."""
    flat = cut_lineage(fx.customers_flat(spark, d).select("row_id", "nation", "region"))
    known = fx.table(spark, d, "nation").where("n_nationkey < 12").select(F.col("n_name").alias("nation"))
    ents = cut_lineage(fx.nations(spark, d, flat).join(known, "nation", "left_semi"))
    decided = cut_lineage(link.link(link.tuples(flat, NATION), ents, NATION))
    merged = link.merge_new(decided.where("is_new"), NATION).select("old_id", F.col("entity_id").alias("merged"))
    out = decided.join(merged, decided.entity_id == merged.old_id, "left").select(*NATION.fields, "c", F.coalesce("merged", "entity_id").alias("entity_id"), "is_new")
    return link.on_tuple(flat, out, NATION).select("row_id", "entity_id", "is_new")


@query
def relink(spark, d):
    flat = cut_lineage(fx.customers_flat(spark, d).select("row_id", "nation", "region"))
    ents = cut_lineage(fx.nations(spark, d, flat))
    decided = link.relink(cut_lineage(link.tuples(flat, NATION)), ents, NATION)
    return link.on_tuple(flat, decided, NATION).select("row_id", "entity_id", "is_new")


# --- entity tables ------------------------------------------------------------------------------------------

@query
def referring_rows(spark, d):
    rows = state.referring_rows({
        "customer.nation": (fx.table(spark, d, "customer"), "c_custkey", "c_nationkey"),
        "supplier.nation": (fx.table(spark, d, "supplier"), "s_suppkey", "s_nationkey"),
        "nation.region": (fx.table(spark, d, "nation"), "n_nationkey", "n_regionkey"),
    })
    return rows.groupBy("path", "entity").agg(F.count("*").alias("n"))


@query
def referring_along(spark, d):
    """Orders by every customer, nation and region they lead to."""
    rows = state.referring_along(fx.table(spark, d, "orders"), "o_orderkey", "o_custkey", [
        ("customer", fx.table(spark, d, "customer"), "c_custkey", "c_nationkey"),
        ("nation", fx.table(spark, d, "nation"), "n_nationkey", "n_regionkey"),
        ("region", fx.table(spark, d, "region"), "r_regionkey", None),
    ])
    return rows.groupBy("path", "entity").agg(F.count("*").alias("n"))


@query
def prune_orphans(spark, d):
    customers = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), "c_name")
    links = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"))
    return state.prune_orphans(customers, links)


@query
def prune_cascade(spark, d):
    kept = state.prune_cascade([
        ("customer", fx.table(spark, d, "customer"), "c_custkey", "c_nationkey"),
        ("nation", fx.table(spark, d, "nation"), "n_nationkey", "n_regionkey"),
        ("region", fx.table(spark, d, "region"), "r_regionkey", None),
    ], fx.table(spark, d, "orders"), "o_custkey")
    keys = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey"}
    out = None
    for name, table in kept.items():
        part = table.select(F.lit(name).alias("class"), F.col(keys[name]).cast("string").alias("entity"))
        out = part if out is None else out.unionByName(part)
    return out


def _swept(spark, d, rounds):
    flat = cut_lineage(fx.customers_flat(spark, d).select("row_id", "c_name", "segment", "nation", "region"))
    links, entities = jobs.sweeps(flat, NATION, rounds)
    return flat, links, entities


def _after(spark, d, rounds):
    flat, links, entities = _swept(spark, d, rounds)
    return flat, jobs.repaired_fields(flat, links, entities, NATION).select("row_id", "nation", "region")


@query
def sweep_once(spark, d):
    return _after(spark, d, 1)[1]


@query
def sweep_twice(spark, d):
    return _after(spark, d, 2)[1]


def _swept_learned(spark, d):
    flat = cut_lineage(fx.customers_flat(spark, d).select("row_id", "nation", "region"))
    return flat, jobs.sweeps_learned(flat, NATION, 2, STRENGTHS, DISCOUNTS)


@query
def sweep_learned(spark, d):
    """Two sweeps that learn the entity-count prior and the regions' weights, and may open entities."""
    flat, out = _swept_learned(spark, d)
    fixed = jobs.repaired_fields(flat, out.links, out.entities, NATION).select("row_id", "nation", "region", "entity_id")
    scores = link.on_tuple(flat, out.links.select("nation", "region", "c", "is_new", "score"), NATION)
    return fixed.join(scores.select("row_id", "is_new", r6("score").alias("score")), "row_id")


@query
def sweep_progress(spark, d):
    """What each sweep learned and did."""
    _, out = _swept_learned(spark, d)
    rows = spark.createDataFrame([tuple(p.values()) for p in out.progress], "sweep int, strength double, discount double, tuples long, records long, opened long, score double")
    return rows.withColumn("score", F.round("score", 3))


def _entity_tables(entities):
    """Nation entities with their reference to region entities, and those."""
    from tablemend.functions.expr import key_hash

    nation = entities.select("entity_id", "nation", F.when(F.col("region").isNotNull(), key_hash("region")).alias("region_id"), "n")
    region = entities.where(F.col("region").isNotNull()).groupBy(key_hash("region").alias("entity_id"), "region").agg(F.sum("n").alias("n"))
    return nation, region


@query
def normalize_tables(spark, d):
    _, _, entities = _swept(spark, d, 1)
    nation, region = _entity_tables(entities)
    return state.entity_rows("nation", nation, "entity_id", ["nation", "region_id"]).unionByName(
        state.entity_rows("region", region, "entity_id", ["region"]))


@query
def inferred_entities(spark, d):
    _, _, entities = _swept(spark, d, 1)
    return _entity_tables(entities)[0]


@query
def reconstruct_flat(spark, d):
    flat, fixed = _after(spark, d, 1)
    segment = jobs.repair_typos(flat, "segment", max_typos=2).select("row_id", F.col("repaired").alias("segment"))
    return state.reconstruct(flat, fixed.join(segment, "row_id"))


@query
def repair_log(spark, d):
    flat, fixed = _after(spark, d, 1)
    return evaluate.repair_log(flat, fixed, ["nation", "region"])


@query
def entity_log(spark, d):
    """Entities that the first sweep makes and drops."""
    flat = cut_lineage(fx.customers_flat(spark, d).select("row_id", "nation", "region"))
    tups, links, seeds = jobs.initial_links(flat, NATION)
    _, entities = link.sweep(tups, links, NATION)
    return state.entity_log(seeds, entities, "nation")


@query
def export_json(spark, d):
    _, _, entities = _swept(spark, d, 1)
    return sinks.to_json_rows(entities, "entity_id", ["nation", "region"])


PART = EntityClass(
    "Part", ["number", "name", "brand"], [["number"], ["name", "brand", "type.desc"]],
    {"type": EntityClass("PartType", ["desc"], [["desc"]])},
)
PART_COLUMNS = {"number": Column("number", typos=False), "name": Column("name"), "brand": Column("brand", typos=False), "type": Column("type.desc")}


@query
def joint_repair(spark, d):
    """All columns of a reference repaired together, through nested classes."""
    records = cut_lineage(fx.part_records(spark, d).select("row_id", "number", "name", "brand", "type"))
    return clean(records, PART, PART_COLUMNS).flat


MARKET = nested.Nested("Market", ("segment",), (nested.Nested("Nation", ("nation",), (nested.Nested("Region", ("region",)),)),))


@query
def clean_nested(spark, d):
    """Three levels of references decided together."""
    records = cut_lineage(fx.markets_dirty(spark, d).select("row_id", "segment", "nation", "region"))
    out = nested.clean_nested(records, MARKET)
    return out.flat.join(out.links, "row_id").select("row_id", "segment", "nation", "region", "Market_id", "Nation_id", "Region_id", "is_new", r6("score").alias("score"))


@query
def nested_tables(spark, d):
    """The entity tables that three levels of references leave behind."""
    records = cut_lineage(fx.markets_dirty(spark, d).select("row_id", "segment", "nation", "region"))
    made, out = nested.clean_nested(records, MARKET).tables, None
    for c in MARKET.classes():
        refers = F.col(c.refs[0].id) if c.refs else F.lit(None).cast("string")
        part = made[c.name].select(F.lit(c.name).alias("class"), "entity_id", F.col(c.attributes[0]).alias("value"), refers.alias("refers_to"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query
def clean_two_tables(spark, d):
    """Customers and suppliers, each with columns of their own, voting on the same nations and regions."""
    sets = {"customer": cut_lineage(fx.customers_flat(spark, d).select("row_id", "nation", "region")), "supplier": cut_lineage(fx.suppliers_flat(spark, d).select("row_id", "country"))}
    shown = {"customer": {"nation": "nation", "region": "region"}, "supplier": {"country": "nation"}}
    out = nested.clean_tables(sets, shown, MARKET.refs[0])
    both = out.flat["customer"].select(F.lit("customer").alias("dataset"), "row_id", "nation", "region").unionByName(
        out.flat["supplier"].select(F.lit("supplier").alias("dataset"), "row_id", F.col("country").alias("nation"), F.lit(None).cast("string").alias("region")))
    return both.join(out.links, ["dataset", "row_id"])


def _flights(spark, d):
    times = declared.Swaps(("part",), "source", RATE, F.col("part") % 100 == F.col("source"))
    records = cut_lineage(fx.claims_of_fields(spark, d).select("row_id", "part", "source", "kind", "brand"))
    return declared.clean_declared(records, {"kind": times, "brand": times})


@query
def clean_flights_like(spark, d):
    """Two fields that sources contradict each other on, one error rate per source, owners trusted."""
    return _flights(spark, d).flat


@query
def learned_rates(spark, d):
    """The error rates that cleaning the fields learned."""
    rates = _flights(spark, d).learned["kind"]
    return rates.select(F.col("_source").alias("source"), "errors", "matches", r6("rate").alias("rate"))


@query
def clean_rents_like(spark, d):
    """A mistyped place, gaps that follow it, and amounts whose unit follows those."""
    records = cut_lineage(fx.listings(spark, d).select("row_id", "key", "place", "area", "kind", "amount"))
    gaps = declared.Usual(("key", "place"))
    return declared.clean_declared(records, {
        "amount": declared.Units(("area", "key", "kind"), UNITS, learn.NormalMean(1500.0, 1000.0), 150.0),
        "area": gaps, "kind": gaps, "place": declared.Typos(("key",)),
    }).flat


@query
def clean_own_model(spark, d):
    """Segments shown in lower case or cut short, by a model whose options are computed from the text."""
    full = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    cut = fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.left("c_mktsegment", F.lit(3) + F.col("c_custkey") % 4)).otherwise(F.col("c_mktsegment")).alias("shown"))
    shortened = declared.Computed(
        options=lambda o: F.filter(F.array(*map(F.lit, full)), lambda x: F.startswith(x, F.upper(o))),
        loglik=lambda o, x: F.when(o == x, F.log(F.lit(0.8))).when(F.upper(o) == x, F.log(F.lit(0.1))).otherwise(F.log(F.lit(0.1)) - F.log(F.length(x).cast("double"))),
    )
    return declared.clean_declared(cut, {"shown": shortened}).flat


# --- repairs --------------------------------------------------------------------------------------------------

@query
def impute(spark, d):
    p = fx.parts_dirty(spark, d)
    return jobs.impute(p, "p_type", ["p_brand"]).select("row_id", "p_type", "was_missing")


@query
def repair_typos(spark, d):
    p = cut_lineage(fx.parts_dirty(spark, d).select("row_id", "p_name"))
    return jobs.repair_typos(p, "p_name", max_typos=2).select("row_id", "repaired", r6("score").alias("score"))


@query
def repair_typos_short(spark, d):
    df = cut_lineage(fx.langs_dirty(spark, d))
    return jobs.repair_typos(df, "shown", max_typos=2).select("row_id", "repaired", r6("score").alias("score"))


@query
def repair_typos_long(spark, d):
    df = cut_lineage(fx.urls_dirty(spark, d).select("row_id", "shown"))
    return jobs.repair_typos(df, "shown", max_typos=2).select("row_id", "repaired", r6("score").alias("score"))


@query
def candidates_long(spark, d):
    df = cut_lineage(fx.urls_dirty(spark, d))
    pairs = candidates.by_segments(df.select(F.col("shown").alias("observed")), df.select(F.col("url").alias("word")), 2)
    return pairs.select("observed", "word", "k")


@query
def unit_correct(spark, d):
    readings = cut_lineage(fx.prices(spark, d).select("row_id", "part", "shown"))
    out = jobs.unit_correct(readings, "shown", ["part"], UNITS, learn.NormalMean(1500.0, 1000.0), 150.0)
    return out.select("row_id", "unit", "corrected")


def _versions(spark, d):
    p = cut_lineage(fx.parts_dirty(spark, d))
    dirty = p.select("row_id", "p_name", "p_type", "p_brand")
    clean = p.select("row_id", F.col("clean_name").alias("p_name"), F.col("clean_type").alias("p_type"), "p_brand")
    # Written, as filling the gaps reads its records several times.
    named = cut_lineage(jobs.repair_typos(dirty, "p_name", max_typos=2).select("row_id", "repaired", "p_type", "p_brand"))
    ours = jobs.impute(named, "p_type", ["p_brand"]).select("row_id", F.col("repaired").alias("p_name"), "p_type")
    return dirty, clean, cut_lineage(ours)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def accuracy(spark, d):
    return _rounded(evaluate.accuracy(*_versions(spark, d), ["p_name", "p_type"]))


@query
def accuracy_prefix(spark, d):
    dirty, clean, ours = _versions(spark, d)
    return _rounded(evaluate.accuracy_prefix(dirty, clean, ours, ["p_name", "p_type"], prepare.position(dirty, "row_id"), 500))


@query
def learning_curve(spark, d):
    return evaluate.learning_curve(*_versions(spark, d), ["p_name", "p_type"]).select("row_no", r6("f1").alias("f1"))


@query
def error_report(spark, d):
    return evaluate.error_report(*_versions(spark, d), ["p_name", "p_type"])


@query
def refresh_batches(spark, d):
    placed = prepare.position(fx.claims(spark, d).select("row_id"), "row_id")
    return placed.groupBy(F.floor(F.col("row_no") / 10000).alias("batch")).agg(F.count("*").alias("n"))


# --- injection --------------------------------------------------------------------------------------------------

@query
def inject_typos(spark, d):
    return fx.parts_dirty(spark, d).select("row_id", F.col("clean_name").alias("clean"), F.col("p_name").alias("dirty"))


@query
def inject_swaps(spark, d):
    return fx.claims(spark, d).select("row_id", F.col("truth").alias("clean"), F.col("claim").alias("dirty"))


@query
def inject_units(spark, d):
    return fx.prices(spark, d).select("row_id", F.col("noisy").alias("clean"), F.col("shown").alias("dirty"))


@query
def inject_noise(spark, d):
    return fx.prices(spark, d).select("row_id", F.col("truth").alias("clean"), F.col("noisy").alias("dirty"))


@query
def inject_name_forms(spark, d):
    return fx.names(spark, d).select("row_id", F.concat_ws(" ", "first", "middle", "last").alias("clean"), F.col("shown").alias("dirty"))


@query
def inject_initials(spark, d):
    n = fx.names(spark, d)
    return inject.initials(n, "last", "dirty", 0.3).select("row_id", F.col("last").alias("clean"), "dirty")


@query
def inject_missing(spark, d):
    return fx.parts_dirty(spark, d).select("row_id", F.col("clean_type").alias("clean"), F.col("p_type").alias("dirty"))


@query
def inject_expansions(spark, d):
    s = _short_names(spark, d)
    opts = s.select(F.col("clean_name").alias("option")).distinct()
    return inject.expansions(s.select("row_id", "short"), "short", "dirty", opts).select("row_id", F.col("short").alias("clean"), "dirty")


# --- streams ----------------------------------------------------------------------------------------------------

def _as_files(spark, df, files):
    """Records landed as that many files, the way a stream would find them."""
    path = scratch_path(spark)
    df.repartition(files, "row_id").write.parquet(f"{path}/in")
    return path


@query
def stream_error_rate(spark, d):
    claims = fx.claims(spark, d)
    # Four batches, each of many files, as a task writes a file.
    per_batch = max(32, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    path = _as_files(spark, claims, 4 * per_batch)
    arriving = stream.arriving(spark, f"{path}/in", claims.schema, per_batch)
    return stream.stream_error_rate(arriving, "claim", "truth", "source", f"{path}/out")


def _linked_stream(spark, d, entities):
    """Customers in three arrivals, each one batch: the stream stops after each and goes on from its checkpoint."""
    flat = fx.customers_flat(spark, d).select("row_id", "nation", "region")
    arrivals = cut_lineage(flat.withColumn("_arrival", F.floor(uniform("arrival", "row_id") * 3)))
    path = scratch_path(spark)
    for i in range(3):
        arrivals.where(F.col("_arrival") == i).drop("_arrival").write.mode("append").parquet(f"{path}/in")
        job = stream.LinkStream(spark, NATION, entities.withColumn("n", F.lit(1)), f"{path}/state")
        links = job.run(stream.arriving(spark, f"{path}/in", flat.schema, files_per_batch=1_000_000))
    return job, links


@query
def stream_link(spark, d):
    _, links = _linked_stream(spark, d, fx.nations(spark, d))
    return links.select("row_id", "entity_id")


@query
def stream_entities(spark, d):
    """Entities and their references after a stream that knew no more than twelve of them at first."""
    known = fx.table(spark, d, "nation").where("n_nationkey < 12").select(F.col("n_name").alias("nation"))
    job, _ = _linked_stream(spark, d, fx.nations(spark, d).join(known, "nation", "left_semi"))
    return job.state().select("entity_id", "nation", "region", "n")
