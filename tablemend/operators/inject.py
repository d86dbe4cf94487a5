"""Error injection: labelled dirty data at any scale, repeatable from the row's key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions.expr import col, is_abbreviation, let, uniform
from tablemend.functions.loglik import LETTERS_PER_TYPO, NO_TYPO_RATE
from tablemend.operators.prepare import position
from tablemend.session import broadcast_if_small

LETTERS = "abcdefghijklmnopqrstuvwxyz"
KEY_LETTERS = 3  # of a short form, by which it is looked up


def _n_typos(word: Column, u: Column, max_typos: int) -> Column:
    """Negative-binomial number of typos by inversion, capped."""
    r = F.ceil(F.length(word) / LETTERS_PER_TYPO)
    mass = F.pow(F.lit(NO_TYPO_RATE), r)
    below, out = mass, F.lit(0)
    for k in range(max_typos):
        out = out + F.when(u >= below, 1).otherwise(0)
        mass = mass * (r + k) * ((1 - NO_TYPO_RATE) / (k + 1))
        below = below + mass
    return out


def _one_typo(word: str, tag: str, key: str, seed: int) -> Column:
    """Insert, delete, swap neighbours or substitute, each a quarter of the time.

    All four keep the letters before a cut, put something in, and go on after ``skip`` letters.
    """

    def edit(v: Column) -> Column:
        w, kind, n = v["w"], v["kind"], F.length(v["w"])
        places = n + F.when(kind == 0, 1).when(kind == 2, -1).otherwise(0)
        cut = F.greatest(F.floor(v["at"] * places), F.lit(0)).cast("int")
        letter = F.substr(F.lit(LETTERS), v["letter"], F.lit(1))
        skip = F.when(kind == 0, 0).when(kind == 2, 2).otherwise(1)
        put = (
            F.when(kind == 0, letter)
            .when(kind == 1, F.lit(""))
            .when(kind == 2, F.reverse(F.substr(w, cut + 1, F.lit(2))))
            .otherwise(F.when(n > 0, letter).otherwise(F.lit("")))
        )
        return F.concat(F.substr(w, F.lit(1), cut), put, F.substr(w, cut + 1 + skip, n))

    return let(
        edit,
        w=word,
        kind=F.floor(uniform(f"{tag}.kind", key, seed) * 4),
        at=uniform(f"{tag}.at", key, seed),
        letter=(F.floor(uniform(f"{tag}.letter", key, seed) * 26) + 1).cast("int"),
    )


def typos(df: DataFrame, column: str, out: str, key: str = "row_id", max_typos: int = 2, seed: int = 7) -> DataFrame:
    """``out`` = ``column`` with up to ``max_typos`` typos."""
    tag = f"typo.{column}"
    df = df.withColumn("_n", _n_typos(F.col(column), uniform(tag, key, seed), max_typos)).withColumn("_w", F.col(column))
    for i in range(max_typos):
        df = df.withColumn("_w", F.when(F.col("_n") > i, _one_typo("_w", f"{tag}.{i}", key, seed)).otherwise(F.col("_w")))
    return df.withColumn(out, F.col("_w")).drop("_n", "_w")


def indexed(options: DataFrame, option: str = "option") -> DataFrame:
    """Options numbered 1..n in a stable order, with n beside each."""
    hashed = options.select(option).distinct().withColumn("_h", F.md5(option))
    numbered = position(hashed, "_h", option, prefix=3, name="idx").drop("_h")
    return numbered.withColumn("n_options", numbered.select(F.count("*")).scalar())


def swaps(df: DataFrame, column: str, out: str, options: DataFrame, rate, key: str = "row_id", seed: int = 7) -> DataFrame:
    """``out`` = a uniformly drawn option at ``rate``, else the value itself."""
    numbered = indexed(options)
    drawn = df.withColumn("_idx", F.floor(uniform(f"pick.{column}", key, seed) * numbered.select(F.max("n_options")).scalar()) + 1)
    pool = broadcast_if_small(numbered.select(F.col("idx").alias("_idx"), F.col("option").alias("_o")))
    hit = uniform(f"swap.{column}", key, seed) < col(rate)
    return drawn.join(pool, "_idx", "left").withColumn(out, F.when(hit, F.col("_o")).otherwise(F.col(column))).drop("_idx", "_o")


def units(df: DataFrame, column: str, out: str, factor: float, rate: float, digits: int, key: str = "row_id", seed: int = 7) -> DataFrame:
    """``out`` = the reading shown in another unit at ``rate``."""
    hit = uniform(f"unit.{column}", key, seed) < rate
    return df.withColumn(out, F.when(hit, F.round(F.col(column) * factor, digits)).otherwise(F.col(column)))


def noise(df: DataFrame, column: str, out: str, std: float, digits: int = 2, key: str = "row_id", seed: int = 7) -> DataFrame:
    """``out`` = the value plus normal noise (two uniforms, polar form)."""
    radius = F.sqrt(-2 * F.ln(uniform(f"noise.{column}.r", key, seed)))
    angle = F.cos(2 * math.pi * uniform(f"noise.{column}.a", key, seed))
    return df.withColumn(out, F.round(F.col(column) + std * radius * angle, digits))


def missing(df: DataFrame, column: str, out: str, rate: float, key: str = "row_id", seed: int = 7) -> DataFrame:
    return df.withColumn(out, F.when(uniform(f"missing.{column}", key, seed) >= rate, F.col(column)))


def name_forms(df: DataFrame, first: str, middle: str, last: str, out: str, key: str = "row_id", seed: int = 7) -> DataFrame:
    """Written-out names with initials and, where there is no middle name, first and last only."""

    def initial(c: str) -> Column:
        return F.concat(F.substring(c, 1, 1), F.lit("."))

    def some(c: str) -> Column:
        return F.when(uniform(f"form.{c}", key, seed) < 0.1, initial(c)).otherwise(F.col(c))

    short = F.col(middle).isNull() | (F.col(middle) == "") | (uniform("form.drop", key, seed) < 0.1)
    return df.withColumn(
        out,
        F.when(short, F.concat_ws(" ", some(first), last)).otherwise(F.concat_ws(" ", some(first), some(middle), last)),
    )


def initials(df: DataFrame, column: str, out: str, rate: float, key: str = "row_id", seed: int = 7) -> DataFrame:
    """``out`` = the initial of a single name at ``rate``, else the name; empty names stay."""
    short = (uniform(f"initial.{column}", key, seed) < rate) & (F.length(column) > 0)
    return df.withColumn(out, F.when(short, F.concat(F.substring(column, 1, 1), F.lit("."))).otherwise(F.col(column)))


def expansions(df: DataFrame, column: str, out: str, options: DataFrame, key: str = "row_id", seed: int = 7) -> DataFrame:
    """``out`` = one of the options the short form could stand for, uniformly; itself if none.

    The draw is made on distinct short forms' expansion lists: a record picks the
    number of its option and joins on (short form, number).
    """
    spelled = expansion_pairs(df.select(F.col(column).alias("short")).distinct(), options)
    sized = spelled.groupBy("short").agg(F.count("*").alias("_n"))
    hashed = spelled.withColumn("_h", F.md5(F.concat_ws("|", "short", "option")))
    numbered = position(hashed, "_h", prefix=2, name="_i", by=["short"]).select(F.col("short").alias("_s"), "_i", "option")
    drawn = (
        df.join(sized.select(F.col("short").alias("_s"), "_n"), F.col(column) == F.col("_s"), "left")
        .withColumn("_i", F.floor(uniform(f"expand.{column}", key, seed) * F.col("_n")) + 1)
    )
    return drawn.join(numbered, ["_s", "_i"], "left").withColumn(out, F.coalesce("option", column)).drop("_s", "_i", "_n", "option")


def _ordered_letters(text: str) -> Column:
    """The distinct runs of up to three letters, none among them, that occur in this order inside the text.

    After a letter's first place all that can follow it still follows, so each run is found once, and the list is bounded by
    the alphabet, not by the length of the text.
    """
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")

    def after(rest: Column, c: Column) -> Column:
        return F.slice(rest, F.array_position(rest, c).cast("int") + 1, F.size(rest))

    def following(rest: Column, before: Column, more: int) -> Column:
        own = F.array_distinct(rest)
        runs = F.transform(own, lambda c: F.concat(before, c))
        if more == 1:
            return runs
        return F.concat(runs, F.flatten(F.transform(own, lambda c: following(after(rest, c), F.concat(before, c), more - 1))))

    return F.concat(F.array(F.lit("")), following(chars, F.lit(""), KEY_LETTERS))


def expansion_candidates(shorts: DataFrame, options: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """(on, short, option): options that hold the three letters of the short form, in their order, which fewest options hold.

    Every three letters of a short form occur in order inside what it abbreviates, so any of them will do as a key: options
    are counted per key, and a short form with a key that no option holds meets none.  Shorter ones are their own key; an
    empty one stands for every option.
    """
    size = F.least(F.length(F.lower("short")), F.lit(KEY_LETTERS))
    own = shorts.select(*on, "short", F.explode(F.filter(_ordered_letters("short"), lambda k: F.length(k) == size)).alias("_c")).distinct()
    wanted = own.select(*on, "_c").distinct()
    listed = options.select(*on, "option", F.explode(_ordered_letters("option")).alias("_c"))
    held = listed.join(wanted, [*on, "_c"], "left_semi").groupBy(*on, "_c").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_c"))
    keyed = own.join(held, [*on, "_c"], "left").groupBy(*on, "short").agg(rarest.alias("_k")).where("_k.n > 0")
    keyed = keyed.select(*on, "short", F.col("_k._c").alias("_c"))
    return keyed.join(listed, [*on, "_c"]).select(*on, "short", "option")


def expansion_pairs(shorts: DataFrame, options: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """(on, short, option) pairs where the short form abbreviates the option."""
    return expansion_candidates(shorts, options, on).where(is_abbreviation("short", "option"))
