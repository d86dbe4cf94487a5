"""Typo pairs of long words: exact whatever stands at the cuts, and not one comparison for all that have much in common."""

import random
import string

import pytest
from pyspark.sql import functions as F

from tablemend.functions.editdist import edit_distance
from tablemend.operators import candidates


def edited(rng: random.Random, w: str, times: int) -> str:
    for _ in range(times):
        i = rng.randrange(len(w) - 1)
        kind = rng.randrange(4)
        w = w[:i] + [rng.choice("abz9") + w[i:], w[i + 1 :], w[i + 1] + w[i] + w[i + 2 :], rng.choice("abz9") + w[i + 1 :]][kind]
    return w


def addresses(rng: random.Random, n: int) -> list[str]:
    return [f"https://{rng.choice(['m', 'www', 'blog'])}.{rng.choice(['thering', 'therin', 'tionsh'])}.example.{rng.choice(['net', 'com'])}/{rng.choice(['en', 'de'])}/{rng.randrange(90000)}" for _ in range(n)]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_pairs_of_long_words_equal_all_pairs(spark, k):
    rng, n = random.Random(k), 12 if k < 3 else 4
    base = addresses(rng, n) + ["".join(rng.choices(string.ascii_lowercase, k=rng.choice([20, 21, 22, 23, 30]))) for _ in range(n)] + ["ü" * 30, "Ä" + "b" * 24]
    # Swaps at every place, so also across every cut, alone and with another edit.
    swapped = [w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in base[:1] + base[n : n + 1] for i in range(len(w) - 1)]
    observed = base + [edited(rng, w, 1 + i % (k + 1)) for i, w in enumerate(base * 2)] + swapped + [edited(rng, w, k - 1) for w in swapped]
    o = spark.createDataFrame([(w,) for w in [*observed, None]], "observed string")
    w = spark.createDataFrame([(x,) for x in [*base, None]], "word string")
    everything = o.distinct().crossJoin(w).distinct().withColumn("k", edit_distance("observed", "word")).where(F.col("k") <= k)
    want = {tuple(r) for r in everything.select("observed", "word", "k").collect()}
    got = candidates.by_segments(o, w, k).select("observed", "word", "k").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_few_pairs_that_meet_are_compared(spark, monkeypatch):
    words = addresses(random.Random(5), 1500)
    df, met, real = spark.createDataFrame([(w,) for w in words], "word string"), [], candidates._by_letters

    def seen(pairs, *more):
        met.append(pairs)
        return real(pairs, *more)

    monkeypatch.setattr(candidates, "_by_letters", seen)
    n = candidates.by_segments(df.select(F.col("word").alias("observed")), df, 2).count()
    changed = F.bit_count(F.col("_lo").bitwiseXOR(F.col("_lw")))
    assert n > len(set(words))
    assert met[0].where(changed <= 4).count() < 0.2 * met[0].count()
