"""The likeliest clean spelling of each entity, found without comparing all of its spellings with one another.

An option's score is the summed typo likelihood of all records of its entity.  Before any pair is formed, every option
gets an upper bound of its score from its support: the records that share one of its candidate keys, as only those
can lie within the typo bound.  Supports are counts per key, so bounds cost what listing the keys costs.  The
options that promise most are scored, and those whose bound stays below what has been reached are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions import loglik
from tablemend.operators.candidates import meet, observed_keys, word_keys
from tablemend.operators.choose import best
from tablemend.session import cut_lineage

# Entities with no more spellings than this compare them all, which is at most this many pairs a spelling.
ALL_PAIRS_UP_TO = 256
# Sums may be off by rounding; a bound this close to the score reached does not count as below it.
SLACK = 1e-9


def _gain(k: Column | int, observed: str, word: str, max_typos: int) -> Column:
    """What a record at ``k`` edits adds to a score.  Records beyond the bound all cost the same, so they add nothing."""
    return loglik.typos(F.lit(k) if isinstance(k, int) else k, observed, word, max_typos) - loglik.IMPOSSIBLE_TYPOS


def scores(spelled: DataFrame, keys: DataFrame, options: DataFrame, max_typos: int) -> DataFrame:
    """(entity_id, word, score) of ``options`` (entity_id, word) over all of ``spelled`` (entity_id, observed, c), whose
    keys are ``keys``."""
    on = ["entity_id"]
    pairs = meet(keys, word_keys(options, max_typos, on), max_typos, on)
    gained = pairs.withColumn("_gain", _gain(F.col("k"), "observed", "word", max_typos)).join(spelled, ["entity_id", "observed"])
    return gained.groupBy("entity_id", "word").agg(F.sum(F.col("c") * F.col("_gain")).alias("score"))


def bounds(spelled: DataFrame, keys: DataFrame, max_typos: int) -> DataFrame:
    """(entity_id, word, c, reach, bound): no option's score is above its bound.

    A key's support is the number of records that list it.  An option's supports over its keys add up to at least
    the records within the bound, as each of those shares a key with it; and no other record is nearer than
    one edit.
    """
    on = ["entity_id"]
    support = keys.join(spelled, ["entity_id", "observed"]).groupBy("entity_id", "_v").agg(F.sum("c").alias("_s"))
    total = spelled.groupBy("entity_id").agg(F.sum("c").alias("_total"))
    own = spelled.select("entity_id", F.col("observed").alias("word"), "c")
    reached = (
        word_keys(own, max_typos, [*on, "c"])
        .join(support, [*on, "_v"])
        .groupBy("entity_id", "word", "c")
        .agg(F.sum(F.col("_s") - F.col("c")).alias("_others"))
        .join(total, "entity_id")
    )
    others = F.least("_others", F.col("_total") - F.col("c"))
    bound = F.col("c") * _gain(0, "word", "word", max_typos) + others * F.greatest(_gain(1, "word", "word", max_typos), F.lit(0.0))
    return reached.select("entity_id", "word", "c", (F.col("c") + F.col("_others")).cast("double").alias("reach"), bound.alias("bound"))


def contenders(spelled: DataFrame, keys: DataFrame, max_typos: int) -> DataFrame:
    """(entity_id, word): the options that may still be the best; the best ones are always among them."""
    bounded = cut_lineage(bounds(spelled, keys, max_typos))
    # Records one edit away share many keys with an option, so the centre of a cloud of spellings reaches most.
    promising = best(bounded, ["entity_id"], "reach", ["word"], ["word"])
    frequent = best(bounded.withColumn("_c", F.col("c").cast("double")), ["entity_id"], "_c", ["word"], ["word"])
    tried = scores(spelled, keys, promising.union(frequent).distinct(), max_typos)
    floor = cut_lineage(tried.groupBy("entity_id").agg(F.max("score").alias("_floor")))
    enough = F.col("_floor") - F.abs(F.col("_floor")) * SLACK - 1e-6
    return bounded.join(floor, "entity_id").where(F.col("bound") >= enough).select("entity_id", "word")


def consensus(named: DataFrame, max_typos: int, all_pairs_up_to: int = ALL_PAIRS_UP_TO) -> DataFrame:
    """(entity_id, word): of the spellings ``named`` (entity_id, observed, c; distinct, none missing) of each entity the one
    with the highest summed typo likelihood, ties to the smallest text.  No rows give no rows.

    Where many spellings are all about equally supported, the bounds drop few of them and their pairs are formed; for words
    above ``candidates.SHORT_WORD`` letters a key is one segment, which many share, so there the bounds are loose.
    """
    spelled = cut_lineage(named.select("entity_id", "observed", F.col("c").cast("long").alias("c")))
    sizes = spelled.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_m"))
    many = sizes.where(F.col("_m") > all_pairs_up_to).select("entity_id")
    keys = observed_keys(spelled, max_typos, ["entity_id"])
    options = spelled.select("entity_id", F.col("observed").alias("word"))
    if not many.isEmpty():
        keys = cut_lineage(keys)
        large = spelled.join(many, "entity_id", "left_semi")
        left = contenders(large, keys.join(many, "entity_id", "left_semi"), max_typos)
        options = options.join(many, "entity_id", "left_anti").union(left)
    return best(scores(spelled, keys, options, max_typos), ["entity_id"], "score", ["word"], ["word"])
