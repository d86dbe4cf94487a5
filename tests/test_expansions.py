"""Short forms and what they stand for: all of the pairs, from few candidates."""

import random

import pytest
from pyspark.sql import functions as F

from tablemend.operators.inject import expansion_candidates, expansion_pairs


def within(short, option):
    letters = iter(option.lower())
    return all(c in letters for c in short.lower())


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.fixture(scope="module")
def sentences():
    rng = random.Random(2)
    vocab = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", range(52, 0, -2), k=rng.randrange(2, 9))) for _ in range(400)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randrange(4, 12))) for _ in range(1600)]


def test_equals_brute_force(spark, sentences):
    rng = random.Random(6)
    options = sentences[:150] + ["", "a", "Ab", "ba", "abab", "Straße", "ÄRGER", "x" * 3000 + "yz", "  ", None]
    shorts = ["".join(w[0] for w in s.split()) for s in sentences[:40]] + ["", "a", "B", "aA", "aba", "xyz", "xxxx", "yx", "äg", "qqqqqq", " ", None]
    shorts += ["".join(sorted(rng.sample(s, 5), key=s.index)) for s in sentences[40:60]]
    got = [tuple(r) for r in expansion_pairs(frame(spark, shorts, "short"), frame(spark, options, "option")).collect()]
    want = {(s, o) for s in shorts for o in options if s is not None and o is not None and within(s, o)}
    assert set(got) == want and len(got) == len(want)


def test_groups_keep_to_themselves(spark):
    shorts = spark.createDataFrame([(1, "nyc"), (2, "nyc"), (3, "nyc"), (None, "nyc")], "g int, short string")
    options = spark.createDataFrame([(1, "new york city"), (2, "new jersey"), (None, "new york city")], "g int, option string")
    assert [tuple(r) for r in expansion_pairs(shorts, options, ["g"]).collect()] == [(1, "nyc", "new york city")]
    for a, b in ((shorts.limit(0), options), (shorts, options.limit(0))):
        assert expansion_pairs(a, b, ["g"]).count() == 0


def test_few_candidates(spark, sentences):
    shorts = ["".join(w[0] for w in s.split()) for s in sentences[:100]]

    def met(n):
        return expansion_candidates(frame(spark, set(shorts), "short"), frame(spark, sentences[:n], "option")).count()

    by_two = sum(within(s[:2], o) for s in set(shorts) for o in sentences)
    few, many = met(400), met(1600)
    # Measured: 22,216 of 160,000 pairs meet, 83,303 would by their first two letters.
    assert many <= 5 * few and many * 3 <= by_two, (few, many, by_two)
