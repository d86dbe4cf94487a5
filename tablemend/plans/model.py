"""Declaring hidden entity tables behind a flat dirty table, and cleaning the table with them.

A class has attributes, references to other classes and one or more keys.  A mapping
says which column shows which attribute, by dotted path.  Cleaning works on cells in
long form (tuple, attribute, value), so its number of shuffles does not depend on how
many columns are mapped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemend.functions import loglik
from tablemend.functions.editdist import edit_distance
from tablemend.functions.expr import key_hash
from tablemend.operators.choose import best
from tablemend.operators.link import LinkModel, link, seed_entities, typo_pairs
from tablemend.session import cut_lineage


@dataclass(frozen=True)
class EntityClass:
    """``keys`` lists alternative sets of attribute paths, each (nearly) enough to recognise an
    entity; the first one names it.  Records meet all entities that agree on a key, so a key
    shared by very many entities is no key: combine it with further attributes."""

    name: str
    attributes: Sequence[str]
    keys: Sequence[Sequence[str]]
    references: Mapping[str, "EntityClass"] = field(default_factory=dict)

    def paths(self, prefix: str = "") -> list[str]:
        own = [prefix + a for a in self.attributes]
        for slot, cls in self.references.items():
            own += cls.paths(f"{prefix}{slot}.")
        return own


@dataclass(frozen=True)
class Column:
    """A column of the flat table: the attribute it shows, and whether with typos or as it is."""

    path: str
    typos: bool = True


@dataclass
class Cleaned:
    links: DataFrame  # row_id, entity_id
    entities: DataFrame  # entity_id, one column per path, n
    tables: dict[str, DataFrame]  # per class
    flat: DataFrame  # the repaired flat table


def _cells(tups: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """(tuple_id, c, path, observed), missing cells left out."""
    entries = [
        F.when(F.col(f"`{name}`").isNotNull(), F.struct(F.lit(c.path).alias("path"), F.lit(c.typos).alias("typos"), F.col(f"`{name}`").cast("string").alias("observed")))
        for name, c in columns.items()
    ]
    return tups.select("tuple_id", "c", F.inline(F.array_compact(F.array(*entries))))


def _canonical(cells: DataFrame, max_typos: int) -> DataFrame:
    """Each cell with the well supported spelling it most likely stands for, per attribute."""
    m = LinkModel("observed", ("path",), max_typos, min_length=1)
    words = cut_lineage(cells.where("typos").groupBy("observed", "path").agg(F.sum("c").alias("c")))
    kept = cut_lineage(seed_entities(words, m))
    spelled = link(words, kept, m).join(kept.select("entity_id", F.col("observed").alias("value")), "entity_id", "left")
    fixed = spelled.select("path", "observed", F.coalesce("value", "observed").alias("value"))
    return cells.join(fixed, ["path", "observed"], "left").withColumn("value", F.coalesce("value", "observed"))


def _recognised(values: DataFrame, owner: str, keys: Sequence[Sequence[str]]) -> DataFrame:
    """(owner, key number, hash) for every key whose attributes are all present."""
    picks = [F.max(F.when(F.col("path") == p, F.col("value"))).alias(p) for p in sorted({p for k in keys for p in k})]
    wide = values.groupBy(owner).agg(*picks)
    hashes = []
    for i, key in enumerate(keys):
        known = F.lit(True)
        for p in key:
            known = known & F.col(f"`{p}`").isNotNull()
        hashes.append(F.when(known, F.struct(F.lit(i).alias("key"), key_hash(*[F.col(f"`{p}`") for p in key]).alias("h"))))
    return wide.select(owner, F.inline(F.array_compact(F.array(*hashes))))


def _vote(linked_cells: DataFrame) -> DataFrame:
    """(entity_id, path, value): the value most records linked to the entity agree on."""
    votes = linked_cells.groupBy("entity_id", "path", "value").agg(F.sum("c").cast("double").alias("score"))
    return best(votes, ["entity_id", "path"], "score", ["value"], ["value"])


# Of entities that share a key with no more others than this, all are candidates.
ALL_OF_KEY = 4
# Larger groups are told apart by every set of their other attributes, up to so many of these.
TOLD_APART_BY = 4
# Priors are compared rounded to 6 decimals: closer ones than this may come out equal.
PRIOR_SLACK = 2e-6


def _agreeing(tuple_keys: DataFrame, entity_keys: DataFrame, cells: DataFrame, attrs: DataFrame, sizes: DataFrame, keys: Sequence[Sequence[str]], columns: Mapping[str, Column], max_typos: int, discount: float) -> DataFrame:
    """(tuple_id, entity_id): of the entities that agree with a tuple on a key those that may be its best.

    Entities of one key differ only in their other attributes and in their references.  Of those whose other values
    are as near to a tuple's cells, and that miss the same values, the one with most references is the best, the smallest
    id among equals.  So a large group keeps one entity for every set of other attributes, the values there and the
    values missing; a tuple meets those whose values its own cells may show.  The pairs follow the tuples, however
    many entities share a key.  With more than ``TOLD_APART_BY`` other attributes there would be too many sets,
    and all entities of the key are met.
    """
    rest = [sorted({c.path for c in columns.values()} - set(k)) for k in keys]
    told = [i for i, r in enumerate(rest) if len(r) <= TOLD_APART_BY]
    if not told:
        return tuple_keys.join(entity_keys, ["key", "h"]).select("tuple_id", "entity_id").distinct()
    shared = entity_keys.groupBy("key", "h").agg(F.count(F.lit(1)).alias("_m")).where((F.col("_m") > ALL_OF_KEY) & F.col("key").isin(told)).drop("_m")
    few = entity_keys.join(shared, ["key", "h"], "left_anti")
    many = cut_lineage(entity_keys.join(shared, ["key", "h"]))
    pairs = tuple_keys.join(few, ["key", "h"]).select("tuple_id", "entity_id")
    if many.isEmpty():
        return pairs.distinct()

    # What stands for an entity: its key, a set of other attributes (their places in the list), and the values there.
    paths = sorted({p for i in told for p in rest[i]})
    known = attrs.where(F.col("path").isin(paths))
    values = known.groupBy("entity_id").agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(f"_v{j}") for j, p in enumerate(paths)])
    listed = many.join(values, "entity_id", "left").join(sizes, "entity_id")

    def sets(i: int) -> list[list[int]]:
        own = [paths.index(p) for p in rest[i]]
        return [[j for b, j in enumerate(own) if s >> b & 1] for s in range(1 << len(own))]

    def sign(i: int, chosen: Sequence[int], value: str) -> SparkColumn:
        """Null where a value is missing, as nothing is near to that."""
        there = reduce(lambda a, j: a & F.col(f"{value}{j}").isNotNull(), chosen, F.lit(True))
        return F.when(there, key_hash(F.lit(i), "h", F.lit(",".join(map(str, chosen))), *[F.col(f"{value}{j}") for j in chosen]))

    def signs(value: str) -> SparkColumn:
        out = F.lit(None).cast("array<string>")
        for i in told:
            out = F.when(F.col("key") == i, F.array_compact(F.array(*[sign(i, chosen, value) for chosen in sets(i)]))).otherwise(out)
        return F.explode(out)

    gaps = key_hash("key", *[F.col(f"_v{j}").isNull() for j in range(len(paths))])
    standing = listed.select("entity_id", "n", gaps.alias("_gaps"), signs("_v").alias("_sign"))
    first = standing.groupBy("_sign", "_gaps", "n").agg(F.min("entity_id").alias("entity_id"))
    support = F.ln(F.col("n") - discount)
    most = F.max("n").over(Window.partitionBy("_sign", "_gaps"))
    first = first.withColumn("_most", most).where(support >= F.ln(F.col("_most") - discount) - PRIOR_SLACK).select("_sign", "entity_id")

    seen = tuple_keys.join(shared, ["key", "h"])
    shown = cells.where(F.col("path").isin(paths)).select("tuple_id", "path", "typos", "observed")
    read = shown.where("not typos").select("tuple_id", "path", F.col("observed").alias("_value"))
    typed = sorted({c.path for c in columns.values() if c.typos} & set(paths))
    if typed:
        spelled = shown.where("typos").select("path", "observed").distinct()
        there = known.where(F.col("path").isin(typed)).join(many.select("entity_id").distinct(), "entity_id", "left_semi").select("path", F.col("value").alias("word")).distinct()
        near = typo_pairs(cut_lineage(spelled), cut_lineage(there), max_typos, ["path"]).select("path", "observed", F.col("word").alias("_value"))
        read = read.unionByName(shown.where("typos").join(near, ["path", "observed"]).select("tuple_id", "path", "_value"))
    for j, p in enumerate(paths):
        seen = seen.join(read.where(F.col("path") == p).select("tuple_id", F.col("_value").alias(f"_o{j}")), "tuple_id", "left")
    met = seen.select("tuple_id", signs("_o").alias("_sign")).distinct().join(first, "_sign").select("tuple_id", "entity_id")
    return pairs.unionByName(met).distinct()


def _score(candidates: DataFrame, tups: DataFrame, columns: Mapping[str, Column], attrs: DataFrame, sizes: DataFrame, max_typos: int, strength: float, discount: float) -> DataFrame:
    """Link prior plus typo likelihoods of all cells.  A cell more than ``max_typos`` away counts as impossible, so
    distances need not be known beyond that.

    A candidate stays one row, with the cells of its tuple and the values of its entity beside it, and meets its tuple
    last, so that the choice among a tuple's candidates finds them together."""
    place = {p: j for j, p in enumerate(sorted({c.path for c in columns.values()}))}
    values = attrs.groupBy("entity_id").agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(f"_v{j}") for p, j in place.items()])
    shown = tups.select("tuple_id", *[F.col(f"`{n}`").cast("string").alias(f"_o{i}") for i, n in enumerate(columns)])
    met = candidates.join(sizes.join(values, "entity_id", "left"), "entity_id").join(shown, "tuple_id")
    fit = F.lit(0.0)
    for i, c in enumerate(columns.values()):
        observed, value = F.col(f"_o{i}"), F.col(f"_v{place[c.path]}")
        unknown = -F.length(observed) * F.ln(F.lit(28.0))  # no value yet: any spelling by letters
        same, far = F.lit(0.0), F.lit(loglik.IMPOSSIBLE_TYPOS)
        if c.typos:
            unlike = observed != value
            met = met.withColumn(f"_k{i}", edit_distance(F.when(unlike, observed), F.when(unlike, value), max_typos))
            same, far = loglik.typos(F.lit(0), observed, observed, 0), loglik.typos(f"_k{i}", observed, value, max_typos)
        fit = fit + F.when(observed.isNull(), 0.0).when(value.isNull(), unknown).when(value == observed, same).otherwise(far)
    total = sizes.select(F.sum("n")).scalar()
    prior = loglik.link_existing("n", total, F.lit(strength), F.lit(discount))
    return met.select("tuple_id", "entity_id", (fit + prior).alias("score"))


def _class_tables(cls: EntityClass, wide: DataFrame, prefix: str, out: dict[str, DataFrame]) -> DataFrame:
    """Add ``cls`` and the classes it refers to to ``out``; return ``wide`` with each reference's
    attributes replaced by the referred entity's (the spelling most of its referrers agree on)."""
    for slot, child in cls.references.items():
        inner = f"{prefix}{slot}."
        paths = child.paths(inner)
        ref = f"{prefix}{slot}_id"
        key = [F.coalesce(F.col(f"`{inner}{k}`"), F.lit("")) for k in child.keys[0]]
        shown = F.coalesce(*[F.col(f"`{inner}{k}`") for k in child.keys[0]]).isNotNull()
        wide = wide.withColumn(ref, F.when(shown, key_hash(F.lit(child.name), *key)))
        long = wide.select(F.col(f"`{ref}`").alias("entity_id"), F.col("n").alias("c"), F.inline(F.array(*[
            F.struct(F.lit(p).alias("path"), F.col(f"`{p}`").alias("value")) for p in paths]))).where("entity_id is not null and value is not null")
        agreed = _vote(long).groupBy("entity_id").agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(p) for p in paths])
        refs = wide.groupBy(F.col(f"`{ref}`").alias("entity_id")).agg(F.sum("n").alias("n"))
        child_wide = _class_tables(child, cut_lineage(agreed.join(refs, "entity_id")), inner, out)
        shared = child_wide.select(F.col("entity_id").alias(ref), *[F.col(f"`{p}`") for p in paths])
        wide = wide.drop(*paths).join(shared, ref, "left")
    refs = [F.col(f"`{prefix}{s}_id`").alias(f"{s}_id") for s in cls.references]
    out[cls.name] = wide.select("entity_id", *[F.col(f"`{prefix}{a}`").alias(a) for a in cls.attributes], *refs, "n")
    return wide


def clean(
    records: DataFrame,
    cls: EntityClass,
    columns: Mapping[str, Column],
    sweeps: int = 1,
    max_typos: int = 2,
    strength: float = 1.0,
    discount: float = 0.25,
) -> Cleaned:
    """Link every record to an entity of ``cls`` through all mapped columns jointly, and repair
    and fill those columns from the entities.

    First clustering: records whose (spelling-corrected) first key agrees.  Each sweep then
    re-estimates the entities from their records and links every tuple to the best entity
    among those agreeing on any key; a tuple agreeing on none stays an entity of its own.
    """
    names = list(columns)
    present = [F.coalesce(F.concat(F.lit("="), F.col(f"`{n}`").cast("string")), F.lit("?")) for n in names]
    keyed = records.select("row_id", *[F.col(f"`{n}`") for n in names], key_hash(*present).alias("tuple_id"))
    tups = cut_lineage(keyed.groupBy("tuple_id").agg(F.count("*").alias("c"), *[F.first(F.col(f"`{n}`")).alias(n) for n in names]))
    cells = cut_lineage(_canonical(_cells(tups, columns), max_typos))

    tuple_keys = cut_lineage(_recognised(cells, "tuple_id", cls.keys))
    sizes_of = tups.where(F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names]).isNotNull()).select("tuple_id", "c")
    first = tuple_keys.where("key = 0").select("tuple_id", key_hash(F.lit(cls.name), F.col("h")).alias("entity_id"))
    links = first
    for _ in range(sweeps):
        links = cut_lineage(links)
        attrs = cut_lineage(_vote(cells.join(links, "tuple_id")))
        sizes = links.join(sizes_of, "tuple_id").groupBy("entity_id").agg(F.sum("c").alias("n"))
        entity_keys = _recognised(attrs, "entity_id", cls.keys)
        candidates = cut_lineage(_agreeing(tuple_keys, cut_lineage(entity_keys), cells, attrs, sizes, cls.keys, columns, max_typos, discount))
        chosen = best(_score(candidates, tups, columns, attrs, sizes, max_typos, strength, discount), ["tuple_id"], "score", ["entity_id"], ["entity_id"])
        own = key_hash(F.lit(cls.name), F.col("tuple_id"))
        links = sizes_of.join(chosen, "tuple_id", "left").select("tuple_id", F.coalesce("entity_id", own).alias("entity_id"))
    links = cut_lineage(links)

    attrs = _vote(cells.join(links, "tuple_id"))
    sizes = links.join(sizes_of, "tuple_id").groupBy("entity_id").agg(F.sum("c").alias("n"))
    paths = cls.paths()
    wide = attrs.groupBy("entity_id").agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(p) for p in paths]).join(sizes, "entity_id")
    tables: dict[str, DataFrame] = {}
    wide = cut_lineage(_class_tables(cls, cut_lineage(wide), "", tables))

    row_links = keyed.select("row_id", "tuple_id").join(links, "tuple_id", "left").select("row_id", "entity_id")
    fixed = wide.select("entity_id", F.struct(*[F.col(f"`{c.path}`").alias(f"c{i}") for i, c in enumerate(columns.values())]).alias("value"))
    # Once per tuple, so that the rows meet one table.  Both sides go by names of their own, as the records may have any.
    decided = links.join(fixed, "entity_id", "left").select("tuple_id", "value")
    found = keyed.select("row_id", "tuple_id").join(decided, "tuple_id", "left").select("row_id", "value")
    joined = records.alias("r").join(found.alias("f"), F.col("r.row_id") == F.col("f.row_id"))
    repaired = {
        n: F.coalesce(F.col(f"f.value.c{i}").cast(records.schema[n].dataType), F.col(f"r.`{n}`")).alias(n) for i, n in enumerate(names)
    }
    flat = joined.select(*[repaired.get(c, F.col(f"r.`{c}`")) for c in records.columns])
    return Cleaned(row_links, wide.select("entity_id", *[F.col(f"`{p}`") for p in paths], "n"), tables, flat)
