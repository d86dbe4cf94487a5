"""Domains: the options a clean value may take, with log-priors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions import loglik
from tablemend.functions.expr import LOG_ZERO, ascii_lower, col, is_time, safe_ln
from tablemend.operators.choose import log_sum_exp
from tablemend.operators.prepare import cells

START = "^"


def domain(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Distinct non-missing values per column, globally or per group."""
    if len(columns) == 1:
        long = df.select(*group, F.lit(columns[0]).alias("column"), F.col(f"`{columns[0]}`").cast("string").alias("option"))
    else:
        long = cells(df, columns, keep=group).withColumnRenamed("value", "option")
    return long.where(F.col("option").isNotNull()).distinct()


def uniform_domain(options: DataFrame, group: Sequence[str] = ("column",)) -> DataFrame:
    """Options with log-prior -ln(count)."""
    sizes = options.groupBy(*group).agg(F.count("*").alias("n_options"))
    return options.join(sizes, list(group)).withColumn("log_prior", loglik.uniform_choice("n_options"))


def weighted_domain(options: DataFrame, weights: DataFrame, on: Sequence[str] = ("option",)) -> DataFrame:
    """Options with log-prior ln(weight); weights of a repeated option add up, none means ln 0."""
    summed = weights.groupBy(*on).agg(F.sum("weight").alias("_w"))
    return options.join(summed, list(on), "left").withColumn("log_prior", loglik.proportional_choice("_w")).drop("_w")


def time_domain(options: DataFrame) -> DataFrame:
    """Well-formed times weigh 1/1440 each, malformed ones nothing, the rest goes to a placeholder."""
    scored = options.select(
        "option",
        F.when(is_time("option"), F.lit(-math.log(1440))).otherwise(F.lit(LOG_ZERO)).alias("log_prior"),
    )
    return with_other(scored, "**:** p.m.")


def with_other(scored: DataFrame, placeholder: str) -> DataFrame:
    """Append a placeholder for every value outside the list, holding the remaining mass."""
    total = F.least(F.col("lse"), F.lit(-1e-12))
    rest = log_sum_exp(scored, [], "log_prior").select(
        F.lit(placeholder).alias("option"),
        F.coalesce(F.log1p(-F.exp(total)), F.lit(LOG_ZERO)).alias("log_prior"),
        F.lit(True).alias("is_placeholder"),
    )
    return scored.withColumn("is_placeholder", F.lit(False)).unionByName(rest)


def text_placeholder(min_length: int, max_length: int) -> str:
    return "*" * ((min_length + max_length) // 2)


def _plain(text: Column | str) -> Column:
    """Text in lower case; anything outside the alphabet becomes '#'."""
    return F.regexp_replace(ascii_lower(text), "[^a-z .]", "#")


def _steps(df: DataFrame, marked: str, keep: Sequence[str]) -> DataFrame:
    """(prev, next) along each marked text.  An unknown letter counts as a fresh start."""
    letters = F.split(marked, "")
    n = F.size(letters) - 1
    pairs = F.arrays_zip(F.slice(letters, F.lit(1), n).alias("prev"), F.slice(letters, F.lit(2), n).alias("next"))
    rows = df.select(*keep, F.inline(pairs))
    return rows.withColumn("prev", F.when(F.col("prev") == "#", F.lit(START)).otherwise(F.col("prev")))


def letter_bigrams(texts: DataFrame, text: str = "text", weight: str | None = None) -> DataFrame:
    """Letter-to-letter probabilities learned from texts, add-one smoothed over the alphabet.

    The result is dense: 29 previous states x 28 letters whatever the input size.
    """
    spark = texts.sparkSession
    count = F.sum(weight) if weight else F.count("*")
    # Cut at spaces, leaving a space on both sides of every cut, each step from letter to letter
    # falls into exactly one piece.  Pieces repeat a lot, so they are counted before their
    # letters are looked at.
    mark = F.lit("\0")
    raw = F.replace(F.col(text), mark, F.lit("#"))
    cut = F.split(F.concat(F.lit(START), F.replace(raw, F.lit(" "), F.concat(F.lit(" "), mark, F.lit(" ")))), "\0")
    pieces = texts.where(F.length(text) > 0).select(*([weight] if weight else []), F.explode(cut).alias("_piece"))
    counted = pieces.groupBy("_piece").agg(count.alias("_n"))
    # The start mark is kept apart from a '^' of the text, which is outside the alphabet.
    first = F.col("_piece").startswith(START)
    plain = F.when(first, F.concat(F.lit(START), _plain(F.substr("_piece", F.lit(2))))).otherwise(_plain("_piece"))
    seen = (
        _steps(counted.select("_n", plain.alias("_piece")), "_piece", ["_n"])
        .where(F.col("next") != "#")
        .groupBy("prev", "next")
        .agg(F.sum("_n").alias("n"))
    )
    size = len(loglik.ALPHABET)
    symbols = F.split(F.lit(loglik.ALPHABET), "")
    grid = spark.range(1).select(F.explode(F.concat(F.array(F.lit(START)), symbols)).alias("prev")).select(
        "prev", F.explode(symbols).alias("next")
    )
    counts = grid.join(F.broadcast(seen), ["prev", "next"], "left").select(
        "prev", "next", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
    totals = counts.groupBy("prev").agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(totals), "prev").select(
        "prev", "next", "n", ((F.col("n") + 1) / (F.col("_t") + size)).alias("p")
    )


def text_prior(words: DataFrame, bigrams: DataFrame, min_length: int, max_length: int, word: str = "word", tails: bool = False) -> DataFrame:
    """Log-probability of each distinct word under the letter model.  Wrong lengths score ln 0, or with
    ``tails`` lose half their probability with each letter too few or too many."""
    marked = words.where(F.length(word) > 0).select(word, F.concat(F.lit(START), _plain(word)).alias("_marked"))
    steps = _steps(marked, "_marked", [word])
    letters = F.broadcast(bigrams.select("prev", "next", "p"))  # 29 x 28 rows by construction
    step = F.when(F.col("next") == "#", F.lit(-math.log(len(loglik.ALPHABET)))).otherwise(
        F.greatest(safe_ln("p"), F.lit(loglik.UNUSUAL_LETTER))
    )
    summed = steps.join(letters, ["prev", "next"], "left").groupBy(word).agg(F.sum(step).alias("_s"))
    fits = F.length(word).between(min_length, max_length)
    base = -math.log(max_length - min_length + 1)
    letters_cost = F.lit(base) + F.coalesce("_s", F.lit(0.0))
    beyond = F.greatest(F.lit(min_length) - F.length(word), F.length(word) - F.lit(max_length))
    other = letters_cost - beyond * math.log(2) if tails else F.lit(LOG_ZERO)
    return words.join(summed, word, "left").withColumn("logp", F.when(fits, letters_cost).otherwise(other)).drop("_s")


def enumerate_options(records: DataFrame, options: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each record (usually an entity) with the options of its own group, by equi-join."""
    return records.join(options, list(on))
