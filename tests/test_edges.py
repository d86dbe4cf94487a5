"""Values of any length, missing keys, absent records and clashing names."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tablemend.functions.expr import key_hash
from tablemend.operators import candidates, evaluate, inject, link, score, spread, state
from tablemend.plans import jobs
from tablemend.plans.recipes import clean_claims
from tablemend.session import broadcast_if_small


def column(spark, values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "row_id string, v string")


def repaired(spark, values):
    out = jobs.repair_typos(column(spark, values), "v", max_typos=2)
    return {r.v: r.repaired for r in out.distinct().collect()}


def test_short_codes_stay(spark):
    codes = ["NY"] * 500 + ["NJ"] * 480 + ["CA"] * 460 + ["TX"] * 470
    assert repaired(spark, codes) == {c: c for c in ("NY", "NJ", "CA", "TX")}
    flags = ["Y"] * 300 + ["N"] * 200 + [""] * 50
    assert repaired(spark, flags) == {c: c for c in ("Y", "N", "")}


@pytest.mark.parametrize("size", [31, 54, 200])
def test_long_names_are_repaired(spark, size):
    rng = random.Random(size)
    name = "".join(rng.choice("abcdefghij ") for _ in range(size))
    other = "".join(rng.choice("abcdefghij ") for _ in range(size))
    wrong = [name[:7] + name[8:], name[: size // 2] + "x" + name[size // 2 :], name[:3] + name[4] + name[3] + name[5:]]
    got = repaired(spark, [name] * 60 + wrong + [other] * 40)
    assert got == {name: name, other: other, **{w: name for w in wrong}}


def test_values_without_candidate_are_counted(spark):
    out = jobs.repair_typos(column(spark, ["alpha beta"] * 50 + ["gamma delta eps"] * 2 + [None]), "v", max_typos=1)
    found = jobs.without_candidate(out, "v").first()
    assert (found.n_values, found.n_rows) == (out.where("v is not null and score is null").select("v").distinct().count(), out.where("v is not null and score is null").count())


def test_a_second_column_does_not_get_the_first_ones_repair(spark):
    rows = [(str(i), "alpha", "gamma") for i in range(50)] + [("x", "alphq", "gamna")]
    df = spark.createDataFrame(rows, "row_id string, a string, b string")
    one = jobs.repair_typos(df, "a", max_typos=1)
    with pytest.raises(ValueError, match="repaired"):
        jobs.repair_typos(one, "b", max_typos=1)
    two = jobs.repair_typos(one, "b", max_typos=1, out="b_repaired", score="b_score")
    r = two.where("row_id = 'x'").first()
    assert (r.repaired, r.b_repaired) == ("alpha", "gamma") and two.count() == 51


def test_clashing_columns_are_an_error(spark):
    rows = spark.createDataFrame([(1, 5.0)], "k int, mean double")
    table = spark.createDataFrame([(1, 7.0, 3)], "k int, mean double, n int")
    with pytest.raises(ValueError, match="mean"):
        spread.spread_join(rows, table, ["k"], "n")
    with pytest.raises(ValueError, match="entity_id"):
        records = spark.createDataFrame([("a", "e")], "v string, entity_id string")
        link.on_tuple(records, spark.createDataFrame([("a", "f")], "v string, entity_id string"), link.LinkModel("v"))


def test_missing_keys_meet_and_no_row_is_lost(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c"), (3, None)], "k int, v string")
    table = spark.createDataFrame([(None, 7, 100), (1, 8, 1)], "k int, t int, n int")
    got = {(r.k, r.v): r.t for r in spread.spread_join(rows, table, ["k"], "n").collect()}
    assert got == {(None, "a"): 7, (1, "b"): 8, (2, "c"): None, (3, None): None}


def test_claims_of_no_entity_keep_their_own(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (None, "a", "own"), (2, "a", None)]
    fixed, _ = clean_claims(spark.createDataFrame(rows, "e int, s string, f string"), "e", "s", ["f"], rounds=2)
    assert sorted(((r.e, r.f) for r in fixed.collect()), key=str) == [(1, "x"), (1, "x"), (1, "x"), (2, None), (None, "own")]


def test_reconstruct_keeps_absent_records(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, "c", "r")], "row_id int, v string, w string")
    new = spark.createDataFrame([(1, "A"), (3, None)], "row_id int, v string")
    assert [tuple(r) for r in state.reconstruct(old, new).collect()] == [(1, "A", "p"), (2, "b", "q"), (3, None, "r")]


def test_lost_records_count_as_not_repaired(spark):
    dirty = spark.createDataFrame([(1, "x"), (2, "y"), (3, "c")], "row_id int, v string")
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_id int, v string")
    ours = spark.createDataFrame([(1, "a")], "row_id int, v string")
    r = evaluate.accuracy(dirty, truth, ours, ["v"]).first()
    assert (r.errors, r.changed, r.cleaned, r.recall) == (2, 1, 1, 0.5)


def test_different_keys_have_different_ids(spark):
    rows = [("a", None), (None, "a"), ("a|b", "c"), ("a", "b|c"), ("", None), (None, ""), ("~", None), (None, None), ("1:a", ""), ("1", ":a")]
    ids = spark.createDataFrame(rows, "x string, y string").select(key_hash("x", "y").alias("i")).distinct().count()
    assert ids == len(rows)


def test_records_without_candidate_stay(spark):
    ents = spark.createDataFrame([("e1", "alpha", "r1", 5), ("e2", "beta", "r2", 4), ("e3", "gamma", "r3", 1)], "entity_id string, name string, region string, n long")
    records = spark.createDataFrame([("1", "alpha", "r1"), ("2", "gamma", None), ("3", "nothing", None), ("4", None, "r1")], "row_id string, name string, region string")
    m = link.LinkModel("name", ("region",))
    cand = link.scored_candidates(link.tuples(records, m), ents, m)
    top = link.link_staged(cand, ents, m, "region", 2, 1.0, 0.25)
    got = {r.row_id: r.e_name for r in link.on_tuple(records, top, m).collect()}
    assert got == {"1": "alpha", "2": "gamma", "3": None, "4": None}


def test_an_empty_short_form_stands_for_every_option(spark):
    options = spark.createDataFrame([("alpha",), ("beta",), ("",)], "option string")
    shorts = spark.createDataFrame([("",), ("a",), ("bt",)], "short string")
    got = {(r.short, r.option) for r in inject.expansion_pairs(shorts, options).collect()}
    assert got == {("", "alpha"), ("", "beta"), ("", ""), ("a", "alpha"), ("a", "beta"), ("bt", "beta")}
    pairs = spark.createDataFrame([("alpha", "")], "observed string, short string")
    scored = score.score_abbreviation(pairs, options, "observed", "short").first()
    assert abs(scored.loglik + 1.0986122886681098) < 1e-9


def test_long_candidates_equal_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randrange(17, 70))) for _ in range(80)]

    def edited(w):
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abc ") + w[i:], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])
        return w

    odf = column(spark, [edited(w) for w in base for _ in range(3)]).toPandas().rename(columns={"v": "observed"})[["observed"]]
    wdf = column(spark, base).toPandas().rename(columns={"v": "word"})[["word"]]
    for k in (1, 2, 3):
        got = {tuple(r) for r in candidates.by_segments(spark.createDataFrame(odf), spark.createDataFrame(wdf), k).select("observed", "word", "k").collect()}
        want = set(duckdb.sql(f"select distinct observed, word, damerau_levenshtein(observed, word)::int from odf, wdf where damerau_levenshtein(observed, word) <= {k}").fetchall())
        assert got == want


def test_candidate_pairs_grow_with_the_words(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(200)]

    def met(n):
        words = [" ".join(rng.choice(vocab) for _ in range(5)) for _ in range(n)]
        df = column(spark, words)
        pairs = candidates.by_segments(df.select(F.col("v").alias("observed")), df.select(F.col("v").alias("word")), 2)
        return pairs.count()

    few, many = met(500), met(2000)
    assert many <= 5 * few


def test_broadcasts_are_measured_in_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 50, "v string")
    hint = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hint(broadcast_if_small(df)) and not hint(broadcast_if_small(df, max_bytes=10_000)) and not hint(broadcast_if_small(df, max_rows=49))


def test_far_pairs_only_reach_python(spark):
    from tablemend.functions.editdist import edit_distance

    df = spark.createDataFrame([("abcdef", "abcdef"), ("abcdef", "bacdef"), ("abcdef", "xyzabc"), ("", "abcd")], "a string, b string")
    got = [r.d for r in df.select(edit_distance("a", "b").alias("d")).collect()]
    assert got == [0, 1, 6, 4]
