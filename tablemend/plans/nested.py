"""Linking records to nested references jointly: an entity that refers to an entity that refers to another.

Every class of the reference tree gets one pass over the distinct observed sub-tuples of its own cells and those
below it, leaves first.  What a class tells the one above is how well its entities explain the
cells (max-sum messages), as a few tables by *anchor*:

* entities that an own cell reaches within the typo bound, each with its exact fit;
* for all entities whose own cells explain nothing: the anchors of the classes below, whose fit is then
  shared by every entity that refers there;
* no anchor at all: nothing matches.

The best existing entity of an anchor is the one with most references, one row per anchor whatever the number of
entities behind it.  So a place whose name is lost is found through its county without pairing it with all
places of that county, and the decision is still the best over all entities.  An entity that does not exist
yet takes the best existing or new one in each of its own references.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions import loglik
from tablemend.functions.expr import IMPOSSIBLE_TYPOS, key_hash
from tablemend.operators.choose import best
from tablemend.operators.link import LinkModel, link, name_prior, on_tuple, seed_entities, typo_pairs
from tablemend.operators.spread import no_clash, spread_join
from tablemend.session import broadcast_if_small, cut_lineage
from tablemend.sources.tables import combine


@dataclass(frozen=True)
class Nested:
    """A class of entities: the record columns that show its attributes, with typos, and the classes it refers to.
    The first attribute names it among entities with the same references.  Class and column names are unique
    within a tree."""

    name: str
    attributes: tuple[str, ...]
    refs: tuple["Nested", ...] = ()

    @property
    def id(self) -> str:
        return f"{self.name}_id"

    @property
    def sub(self) -> str:
        return f"{self.name}_sub"

    def classes(self) -> Iterator["Nested"]:
        """This class and all below it."""
        yield self
        for r in self.refs:
            yield from r.classes()

    def columns(self) -> list[str]:
        return [a for c in self.classes() for a in c.attributes]

    def sub_key(self) -> Column:
        return key_hash(F.lit(self.name), *[F.col(f"`{c}`") for c in self.columns()]).alias(self.sub)


@dataclass(frozen=True)
class Prior:
    strength: float = 1.0
    discount: float = 0.25


@dataclass
class NestedResult:
    links: DataFrame  # row_id, <Class>_id of every class, is_new, score
    tables: dict[str, DataFrame]  # per class: entity_id, attributes, <Ref>_id, n
    flat: DataFrame  # the records with the columns of their entities


def seed_tables(tups: DataFrame, cls: Nested, max_typos: int = 2, prior: Prior = Prior()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``tups`` (columns of the tree, c) with the entity each class's cells name by themselves, and the entity
    tables those make: leaves first, spellings of one entity told apart by what they refer to."""
    tables: dict[str, DataFrame] = {}
    for r in cls.refs:
        tups, below = seed_tables(tups, r, max_typos, prior)
        tables |= below
    refs = [r.id for r in cls.refs]
    m = LinkModel(cls.attributes[0], tuple(refs), max_typos, strength=prior.strength, discount=prior.discount)
    own = cut_lineage(tups.groupBy(*m.fields).agg(F.sum("c").alias("c")))
    seeds = cut_lineage(seed_entities(own, m))
    # Written, as the join with the tuples reads it three times.
    named = cut_lineage(link(own, seeds, m).select(*m.fields, "c", F.when(F.col(m.name).isNotNull(), F.col("entity_id")).alias(cls.id)))
    tups = cut_lineage(on_tuple(tups, named, m))
    table = seeds.select("entity_id", m.name, *refs, "n")
    for a in cls.attributes[1:]:  # what most records that name the entity show
        votes = tups.where(F.col(a).isNotNull() & F.col(cls.id).isNotNull()).groupBy(F.col(cls.id).alias("entity_id"), a).agg(F.sum("c").cast("double").alias("score"))
        table = table.join(best(votes, ["entity_id"], "score", [a], [a]), "entity_id", "left")
    tables[cls.name] = cut_lineage(table.select("entity_id", *cls.attributes, *refs, "n"))
    return tups, tables


def _closure(cls: Nested, tables: dict[str, DataFrame]) -> DataFrame:
    """(<Class>_id of the class and all below it, e_<attribute>, n) of every entity."""
    out = tables[cls.name].select(F.col("entity_id").alias(cls.id), *[F.col(a).alias(f"e_{a}") for a in cls.attributes], *[r.id for r in cls.refs], "n")
    for r in cls.refs:
        below = _closure(r, tables).select(*[c.id for c in r.classes()])
        out = out.join(below, r.id, "left")
    return out.select(*[c.id for c in cls.classes()], *[f"e_{a}" for a in cls.attributes], "n")


@dataclass
class _Message:
    reach: dict[tuple[str, ...], DataFrame]  # by anchor classes: (sub, their ids, fit)
    best: DataFrame  # (sub, ids of the class and all below it, is_new, score)


def _matching(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which missing matches missing."""
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return left.alias("l").join(right.alias("r"), same).select("l.*", *[F.col(f"r.`{c}`") for c in right.columns if c not in on])


def _first(cls: Nested, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Of the entities that agree on ``keys`` the one with most references: keys, the ids, n."""
    rest = [c.id for c in cls.classes() if c.id not in keys]
    first = entities.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c).alias(f"_{c}") for c in rest], "n"), F.struct((-F.col("n")).alias("m"), cls.id)).alias("_t"))
    return first.where("_t is not null").select(*keys, *[F.col(f"_t._{c}").alias(c) for c in rest], "_t.n")


def _existing(cls: Nested, subs: DataFrame, entities: DataFrame, pairs: dict[str, DataFrame], kids: list["_Message"], told: Column, prior_of: Column) -> DataFrame:
    """(sub, ids, is_new, score): existing entities for each sub-tuple of the first class, the best among them.

    Nothing above asks which entities there are, so they are not listed for each sub-tuple: what the references
    of a sub-tuple say is weighed once for all that share them, and of the entities that its own cells and an anchor cannot
    tell apart only the one with most references is looked at.
    """
    ids, attrs, refs = [c.id for c in cls.classes()], list(cls.attributes), [r.sub for r in cls.refs]
    shown_by = [f"e_{a}" for a in attrs]
    # How well the own cells are explained by those of an entity that at least one of them reaches.
    shown, words, met = subs.select(*attrs).distinct(), entities.select(*shown_by).distinct(), None
    for a in attrs:
        near = pairs[a].select(F.col("observed").alias(a), F.col("word").alias(f"e_{a}"))
        via = shown.join(near, a).join(words, f"e_{a}").select(*attrs, *shown_by)
        met = via if met is None else met.union(via)
    met, own = met.distinct(), F.lit(0.0)
    for i, a in enumerate(attrs):
        met = met.join(pairs[a].select(F.col("observed").alias(a), F.col("word").alias(f"e_{a}"), F.col("loglik").alias(f"_own{i}")), [a, f"e_{a}"], "left")
        own = own + F.when(F.col(a).isNull(), 0.0).otherwise(F.coalesce(f"_own{i}", F.lit(IMPOSSIBLE_TYPOS)))
    fits = cut_lineage(met.select(*attrs, *shown_by, own.alias("_own")))
    reached = cut_lineage(_matching(subs, fits, attrs).select(cls.sub, *refs, *shown_by, "_own"))
    wanted = cut_lineage(reached.select(*refs, *shown_by).distinct())
    apart = subs.select(*refs).distinct()

    options = None
    for anchors in product(*[kid.reach for kid in kids]):
        on = [f"{x}_id" for x in sum(anchors, ())]

        def below(rows: DataFrame) -> DataFrame:
            fit = F.lit(0.0)
            for i, (r, kid, a) in enumerate(zip(cls.refs, kids, anchors, strict=True)):  # noqa: B023
                rows, fit = rows.join(kid.reach[a].withColumnRenamed("fit", f"_fit{i}"), r.sub), fit + F.col(f"_fit{i}")
            return rows.withColumn("_below", fit)

        alike, most = (broadcast_if_small(cut_lineage(_first(cls, entities, k))) for k in ([*on, *shown_by], on))
        weighed = below(wanted).alias("w")
        same = F.lit(True)
        for c in on:
            same = same & (F.col(f"w.{c}") == F.col(f"f.{c}"))
        for c in shown_by:
            same = same & F.col(f"w.`{c}`").eqNullSafe(F.col(f"f.`{c}`"))
        found = weighed.join(alike.alias("f"), same).select(*[F.col(f"w.`{c}`") for c in (*refs, *shown_by)], *[F.col(f"f.{c}") for c in ids], (prior_of + F.col("_below")).alias("_score"))
        top = best(found, [*refs, *shown_by], "_score", [cls.id], [*ids, "_score"])
        near = _matching(reached, top, [*refs, *shown_by]).select(cls.sub, *ids, (F.col("_score") + F.col("_own")).alias("score"))

        weighed = below(apart)
        found = weighed.join(most, on) if on else weighed.withColumn("_one", F.lit(1)).join(F.broadcast(most.withColumn("_one", F.lit(1))), "_one")  # a single row
        top = best(found.select(*refs, *ids, (prior_of + F.col("_below")).alias("_score")), refs, "_score", [cls.id], [*ids, "_score"])
        far = subs.select(cls.sub, *refs, told.alias("_told")).join(top, refs).select(cls.sub, *ids, (F.col("_score") + F.col("_told")).alias("score"))
        both = near.unionByName(far)
        options = both if options is None else options.unionByName(both)
    return options.select(cls.sub, *ids, F.lit(False).alias("is_new"), "score")


def _message(cls: Nested, tups: DataFrame, tables: dict[str, DataFrame], max_typos: int, prior: Prior, top: bool = False) -> _Message:
    """``top``: nothing above reads what the entities are reached by."""
    kids = [_message(r, tups, tables, max_typos, prior) for r in cls.refs]
    ids, attrs = [c.id for c in cls.classes()], list(cls.attributes)
    entities = cut_lineage(_closure(cls, tables))
    subs = cut_lineage(tups.groupBy(*cls.columns()).agg(F.sum("c").alias("c")).select(cls.sub_key(), *attrs, *[r.sub_key() for r in cls.refs], "c"))
    pairs = {a: cut_lineage(typo_pairs(subs.select(F.col(a).alias("observed")), entities.select(F.col(f"e_{a}").alias("word")), max_typos)) for a in attrs}
    told = F.lit(0.0)
    for a in attrs:
        told = told + F.when(F.col(a).isNull(), 0.0).otherwise(IMPOSSIBLE_TYPOS)
    numbers = entities.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("many")).first()
    strength, discount = F.lit(prior.strength), F.lit(prior.discount)
    reach: dict[tuple[str, ...], DataFrame] = {}
    if top and cls.refs:
        options = _existing(cls, subs, entities, pairs, kids, told, loglik.link_existing("n", F.lit(numbers["total"]), strength, discount))
    else:
        reach, options = _reached(cls, subs, entities, pairs, kids, told, loglik.link_existing("n", F.lit(numbers["total"]), strength, discount))

    opened = subs
    score = loglik.link_new(F.lit(numbers["many"]), F.lit(numbers["total"]), strength, discount)
    for i, a in enumerate(attrs):
        letters = cut_lineage(name_prior(subs.select(a, "c"), LinkModel(a, (), max_typos)).select(F.col("word").alias(a), F.col("logp").alias(f"_logp{i}")))
        opened = opened.join(letters, a, "left")
        score = score + F.when(F.col(a).isNull(), 0.0).otherwise(F.col(f"_logp{i}") + loglik.typos(F.lit(0), a, a, max_typos))
    for i, (r, kid) in enumerate(zip(cls.refs, kids, strict=True)):
        opened = opened.join(kid.best.drop("is_new").withColumnRenamed("score", f"_best{i}"), r.sub)
        score = score + F.col(f"_best{i}")
    own_id = key_hash(*[F.coalesce(F.col(a), F.lit("")) for a in attrs], *[F.col(r.id) for r in cls.refs]).alias(cls.id)
    options = options.unionByName(opened.select(cls.sub, own_id, *ids[1:], F.lit(True).alias("is_new"), score.alias("score")))
    return _Message(reach, cut_lineage(best(options, [cls.sub], "score", ["is_new", cls.id], [*ids, "is_new", "score"])))


def _reached(cls: Nested, subs: DataFrame, entities: DataFrame, pairs: dict[str, DataFrame], kids: list["_Message"], told: Column, prior_of: Column) -> tuple[dict[tuple[str, ...], DataFrame], DataFrame]:
    """By anchor classes (sub, their ids, fit), and the existing entities they lead to: (sub, ids, is_new, score)."""
    ids, attrs = [c.id for c in cls.classes()], list(cls.attributes)
    reach: dict[tuple[str, ...], DataFrame] = {}

    # Entities that an own cell reaches, with the fit of all cells.
    met = None
    for a in attrs:
        near = pairs[a].select(F.col("observed").alias(a), F.col("word").alias(f"e_{a}"))
        via = subs.select(cls.sub, a).join(near, a).join(entities.select(cls.id, f"e_{a}"), f"e_{a}").select(cls.sub, cls.id)
        met = via if met is None else met.union(via)
    met = met.distinct().join(subs, cls.sub).join(entities, cls.id)
    fit = F.lit(0.0)
    for i, a in enumerate(attrs):
        met = met.join(pairs[a].select(F.col("observed").alias(a), F.col("word").alias(f"e_{a}"), F.col("loglik").alias(f"_own{i}")), [a, f"e_{a}"], "left")
        fit = fit + F.when(F.col(a).isNull(), 0.0).otherwise(F.coalesce(f"_own{i}", F.lit(IMPOSSIBLE_TYPOS)))
    for i, (r, kid) in enumerate(zip(cls.refs, kids, strict=True)):
        fits = []
        for j, (anchors, told_below) in enumerate(kid.reach.items()):
            fits.append(F.col(f"_ref{i}_{j}"))
            met = met.join(told_below.withColumnRenamed("fit", f"_ref{i}_{j}"), [r.sub, *[f"{x}_id" for x in anchors]], "left")
        fit = fit + (F.greatest(*fits) if len(fits) > 1 else fits[0])
    reach[cls.name,] = cut_lineage(met.select(cls.sub, cls.id, fit.alias("fit")))

    # All other entities, by what they refer to.
    for anchors in product(*[kid.reach for kid in kids]):
        rest, fit = subs.select(cls.sub, *[r.sub for r in cls.refs], told.alias("_told")), F.col("_told")
        for i, (r, kid, a) in enumerate(zip(cls.refs, kids, anchors, strict=True)):
            rest, fit = rest.join(kid.reach[a].withColumnRenamed("fit", f"_fit{i}"), r.sub), fit + F.col(f"_fit{i}")
        named = sum(anchors, ())
        # Written, so that the plans above hold one small table instead of all below it.
        reach[named] = cut_lineage(rest.select(cls.sub, *[f"{x}_id" for x in named], fit.alias("fit")))

    options = None
    for anchors, frame in reach.items():
        on = [f"{x}_id" for x in anchors]
        if anchors == (cls.name,):
            found = frame.join(entities, on)
        else:  # of the entities behind an anchor the one with most references
            first = _first(cls, entities, on)
            found = frame.join(first, on) if on else frame.withColumn("_one", F.lit(1)).join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one")  # a single row
        scored = found.select(cls.sub, *ids, F.lit(False).alias("is_new"), (prior_of + F.col("fit")).alias("score"))
        options = scored if options is None else options.unionByName(scored)

    return reach, options


def link_nested(tups: DataFrame, cls: Nested, tables: dict[str, DataFrame], max_typos: int = 2, prior: Prior = Prior()) -> DataFrame:
    """``tups`` (the tree's columns, c) with the likeliest entities of all classes together: <Class>_id, is_new (of the
    first class) and score.

    An entity's score is its Pitman-Yor prior and the typo likelihood of every cell in its tree; a cell beyond
    ``max_typos`` counts as impossible, a missing one says nothing.  A new entity pays the letters of its cells.  Ties go
    to existing entities, then to the smallest id.
    """
    decided = _message(cls, tups, tables, max_typos, prior, top=True).best
    return tups.withColumn(cls.sub, cls.sub_key()).join(decided, cls.sub).drop(cls.sub)


def _values(cls: Nested, tables: dict[str, DataFrame], linked: DataFrame) -> dict[str, DataFrame]:
    """The entity tables that ``linked`` tuples refer to, new entities among them, with their numbers of references."""
    out = {}
    for c in cls.classes():
        refs = [r.id for r in c.refs]
        # A new entity's cells are those of its tuples, so any of them will do.
        named = linked.groupBy(c.id).agg(*[F.min(a).alias(f"_{a}") for a in c.attributes], *[F.min(r).alias(f"_{r}") for r in refs], F.sum("c").alias("_n"))
        old = tables[c.name].withColumnRenamed("entity_id", c.id).withColumn("_old", F.lit(True)).drop("n")
        both = named.join(old, c.id, "left")
        shown = [F.when(F.col("_old"), F.col(x)).otherwise(F.col(f"_{x}")).alias(x) for x in (*c.attributes, *refs)]
        out[c.name] = cut_lineage(both.select(F.col(c.id).alias("entity_id"), *shown, F.col("_n").alias("n")))
    return out


def clean_nested(records: DataFrame, cls: Nested, max_typos: int = 2, prior: Prior = Prior()) -> NestedResult:
    """Links every record (row_id, the tree's columns, others) through all its cells at once, and repairs and
    fills the columns from the entities.  Entities that nothing refers to after that are gone."""
    columns = cls.columns()
    no_clash(records, [c.id for c in cls.classes()] + [c.sub for c in cls.classes()] + ["is_new", "score", "c"])
    tups = cut_lineage(records.groupBy(*columns).agg(F.count(F.lit(1)).alias("c")))
    _, tables = seed_tables(tups, cls, max_typos, prior)
    linked = cut_lineage(link_nested(tups, cls, tables, max_typos, prior))
    tables = _values(cls, tables, linked)
    ids = [c.id for c in cls.classes()]
    fixed = linked
    for c in cls.classes():
        fixed = fixed.join(tables[c.name].select(F.col("entity_id").alias(c.id), *[F.col(a).alias(f"_{a}") for a in c.attributes]), c.id, "left")
    fixed = cut_lineage(fixed.select(*columns, *ids, "is_new", "score", F.col("c").alias("_copies"), *[f"_{a}" for a in columns]))
    out = spread_join(records, fixed, columns, "_copies")
    repaired = {a: F.coalesce(f"_{a}", a).alias(a) for a in columns}
    return NestedResult(out.select("row_id", *ids, "is_new", "score"), tables, out.select(*[repaired.get(c, F.col(f"`{c}`")) for c in records.columns]))


@dataclass
class SharedResult:
    links: DataFrame  # dataset, row_id (as text), <Class>_id of every class
    tables: dict[str, DataFrame]
    flat: dict[str, DataFrame]  # each dataset with its own columns repaired


def clean_tables(datasets: Mapping[str, DataFrame], columns: Mapping[str, Mapping[str, str]], cls: Nested, max_typos: int = 2, prior: Prior = Prior()) -> SharedResult:
    """:func:`clean_nested` over several tables that show the same entities in columns of their own.

    ``columns`` says for each dataset which of its columns shows which column of the tree; what a dataset does not
    show is missing there.  The cells of all datasets vote on the entities together.
    """
    aligned = combine({n: df.select(F.col("row_id").cast("string").alias("row_id"), *[F.col(f"`{c}`").cast("string").alias(a) for c, a in columns[n].items()]) for n, df in datasets.items()})
    for a in cls.columns():
        if a not in aligned.columns:
            aligned = aligned.withColumn(a, F.lit(None).cast("string"))
    rows = cut_lineage(aligned.select(key_hash("dataset", "row_id").alias("row_id"), F.struct("dataset", "row_id").alias("_own"), *cls.columns()))
    out = clean_nested(rows, cls, max_typos, prior)
    ids = [c.id for c in cls.classes()]
    links = out.links.join(rows.select("row_id", "_own"), "row_id").select("_own.dataset", "_own.row_id", *ids)
    fixed, flat = cut_lineage(out.flat), {}
    for n, df in datasets.items():
        found = fixed.where(F.col("_own.dataset") == n).select(F.col("_own.row_id").alias("id"), F.struct(*columns[n].values()).alias("value"))
        joined = df.alias("r").join(found.alias("f"), F.col("r.row_id").cast("string") == F.col("f.id"))
        shown = {c: F.col(f"f.value.`{a}`").cast(df.schema[c].dataType).alias(c) for c, a in columns[n].items()}
        flat[n] = joined.select(*[shown.get(c, F.col(f"r.`{c}`")) for c in df.columns])
    return SharedResult(links, out.tables, flat)
