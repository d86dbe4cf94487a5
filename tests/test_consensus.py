"""Bounds on options: the same answer as the full search, from few of its pairs."""

import random

from tablemend.operators.candidates import observed_keys
from tablemend.operators.consensus import bounds, consensus, contenders, scores
from tablemend.session import cut_lineage

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def mistyped(rng, word, edits):
    for _ in range(edits):
        i = rng.randrange(len(word))
        kind = rng.randrange(4)
        if kind == 0:
            word = word[:i] + rng.choice(LETTERS) + word[i:]
        elif kind == 1 and len(word) > 1:
            word = word[:i] + word[i + 1 :]
        elif kind == 2 and i + 1 < len(word):
            word = word[:i] + word[i + 1] + word[i] + word[i + 2 :]
        else:
            word = word[:i] + rng.choice(LETTERS) + word[i + 1 :]
    return word


def spellings(rng, entity, word, n, edits=(0, 1, 2)):
    out = {}
    for _ in range(n):
        shown = mistyped(rng, word, rng.choice(edits))
        out[shown] = out.get(shown, 0) + 1
    return [(entity, w, c) for w, c in out.items()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, observed string, c long")


def test_equals_the_full_search(spark):
    rng = random.Random(5)
    rows = [("empty", "", 3), ("empty", "a", 1), ("one", "x", 1), ("tie", "abcd", 2), ("tie", "abdc", 2)]
    for e, word in enumerate(["united kingdom", "peru", "ab", "a name much longer than twenty letters", "twentyletterslongyes", "saudi arabia"]):
        rows += spellings(rng, f"e{e}", word, 60)
    # Two words far apart in one entity, one with more copies, the other with more spellings.
    rows += [("two", "mozambique", 9)] + spellings(rng, "two", "kazakhstan", 40, (1, 2))
    named = cut_lineage(frame(spark, rows))
    full = {tuple(r) for r in consensus(named, 2, all_pairs_up_to=10**9).select("entity_id", "word").collect()}
    assert len(full) == 10
    assert {tuple(r) for r in consensus(named, 2, all_pairs_up_to=0).select("entity_id", "word").collect()} == full
    assert {tuple(r) for r in consensus(named, 2, all_pairs_up_to=20).select("entity_id", "word").collect()} == full
    exact = scores(named, observed_keys(named, 2, ["entity_id"]), named.selectExpr("entity_id", "observed AS word"), 2)
    both = exact.join(bounds(named, observed_keys(named, 2, ["entity_id"]), 2), ["entity_id", "word"]).collect()
    assert len(both) == len(rows) and all(r.bound >= r.score * (1 - 1e-9) for r in both)


def test_no_rows(spark):
    assert consensus(frame(spark, []), 2).count() == 0


def test_options_left_do_not_grow_with_the_spellings(spark):
    """What is left are spellings one edit from the centre, however many others there are."""
    left = {}
    for n in (1000, 4000):
        named = cut_lineage(frame(spark, spellings(random.Random(n), "e", "dominican republic", n, (2,))))
        keys = cut_lineage(observed_keys(named, 2, ["entity_id"]))
        left[n] = contenders(named, keys, 2).collect()
        assert "dominican republic" in {r.word for r in left[n]} and len(left[n]) <= 0.03 * named.count()
    assert consensus(named, 2).first().word == "dominican republic"
