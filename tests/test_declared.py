"""Columns with their own error models: equal to the ready-made recipes, in any order of declaration."""

import pytest
from pyspark.sql import functions as F

from tablemend.functions.units import IDENTITY, THOUSANDS
from tablemend.operators import learn
from tablemend.operators.learn import Beta, NormalMean, lookup
from tablemend.plans import fixtures as fx
from tablemend.plans.declared import Computed, Swaps, Typos, Units, Usual, _waves, clean_declared
from tablemend.plans.recipes import clean_claims, clean_listings
from tablemend.session import cut_lineage

PRIOR = Beta(10.0, 50.0)


def same(a, b):
    a, b = cut_lineage(a), cut_lineage(b)
    return a.select(*b.columns).exceptAll(b).count() == 0 and b.exceptAll(a.select(*b.columns)).count() == 0


def test_as_the_recipe_for_claims(spark, sf):
    records = cut_lineage(fx.claims_of_fields(spark, sf))
    owns = F.col("part") % 100 == F.col("source")
    want, rates = clean_claims(records, "part", "source", ["kind", "brand"], 3, PRIOR, owns)
    model = Swaps(("part",), "source", PRIOR, owns, rounds=3)
    got = clean_declared(records, {"kind": model, "brand": model})
    got.flat = cut_lineage(got.flat)
    assert same(got.flat, want)
    learned = {r._source: r.rate for r in got.learned["kind"].collect()}
    assert learned == {r.source: pytest.approx(r.rate) for r in rates.collect()} and got.learned["kind"] is got.learned["brand"]
    right, before = got.flat.select(F.avg((F.col("kind") == F.col("true_kind")).cast("int"))).first()[0], records.select(F.avg((F.col("kind") == F.col("true_kind")).cast("int"))).first()[0]
    assert right > before


def test_as_the_recipe_for_listings(spark, sf):
    records = cut_lineage(fx.listings(spark, sf))
    want = clean_listings(records, "key", "place", "area", "kind", "amount", max_typos=2)
    gaps = Usual(("key", "place"))
    got = clean_declared(records, {
        "amount": Units(("area", "key", "kind"), (IDENTITY, THOUSANDS), NormalMean(1500.0, 1000.0), 150.0), "area": gaps, "kind": gaps, "place": Typos(("key",)),
    })
    assert same(got.flat, want)


def test_waves():
    a, b, c = Usual(("x",)), Usual(("a",)), Usual(("b", "a"))
    assert _waves({"c": c, "b": b, "a": a}) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError, match="depend on each other"):
        _waves({"p": Usual(("q",)), "q": Usual(("p",))})


def test_missing_contexts_and_own_models(spark):
    rows = [(1, None, "a", "x"), (2, None, "a", None), (3, "k", None, None), (4, "k", "b", "y"), (5, "e", None, None), (6, None, "a", "x"), (7, None, "c", "z")]
    df = spark.createDataFrame(rows, "row_id long, k string, p string, q string")
    got = {r.row_id: (r.p, r.q) for r in clean_declared(df, {"p": Usual(("k",)), "q": Usual(("k", "p"))}).flat.collect()}
    assert got == {1: ("a", "x"), 2: ("a", "x"), 3: ("b", "y"), 4: ("b", "y"), 5: ("a", "x"), 6: ("a", "x"), 7: ("c", "z")}
    shout = Computed(lambda o: F.array(F.upper(o), o), lambda o, x: F.when(o == x, -2.0).otherwise(-1.0), lambda x: F.when(x == "Y", -9.0).otherwise(0.0))
    assert [r.q for r in clean_declared(df, {"q": shout}).flat.orderBy("row_id").collect()] == ["X", None, None, "y", None, "X", "Z"]
    nothing = Computed(lambda o: F.array().cast("array<string>"), lambda o, x: F.lit(0.0))
    assert same(clean_declared(df, {"q": nothing}).flat, df)
    assert clean_declared(df.limit(0), {"p": Usual(("k",)), "q": Typos(("p",))}).flat.collect() == []


def test_numbers_keep_their_type(spark):
    df = spark.createDataFrame([(k, "g", 1000.0 + k if k % 3 else 1.0 + k / 1000, "note") for k in range(30)] + [(30, None, 1.2, "note"), (31, "g", None, "note")], "row_id long, g string, x double, _u string")
    out = clean_declared(df, {"x": Units(("g",), (IDENTITY, THOUSANDS), NormalMean(1500.0, 1000.0), 50.0)}).flat
    got = {r.row_id: r.x for r in out.collect()}
    assert out.schema == df.schema and all(got[k] == 1000.0 + k for k in range(30)) and got[30] == 1200.0 and got[31] is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_move_once_for_columns_of_one_group(spark):
    rows = [(i, i % 7 if i % 11 else None, i % 5, "ab"[i % 3 == 0], "cd"[i % 4 == 0] if i % 6 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, part int, source int, kind string, brand string")
    model = Swaps(("part",), "source", PRIOR, rounds=2)
    flat = clean_declared(df, {"kind": model, "brand": model}).flat
    assert "hashpartitioning(row_id" not in plan(flat)
    got = {r.row_id: r for r in flat.collect()}
    assert len(got) == 200 and all(got[i].kind == s for i, p, _, s, _ in rows if p is None)
    assert all(len({(r.kind, r.brand) for r in got.values() if r.part == p}) == 1 for p in range(7))


def test_few_parameters_leave_rows_where_they_are(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "row_id long, source string")
    rates = spark.createDataFrame([("a", 0.1, 5), ("b", 0.2, 6), (None, 0.3, 1)], "source string, rate double, n long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup(df, rates, ["source"], "rate", 0.5, "n")
        assert "hashpartitioning" not in plan(out)
        assert {r.row_id: r.rate for r in out.collect()} == {1: 0.1, 2: 0.2, 3: 0.3, 4: 0.5}
        with pytest.MonkeyPatch.context() as m:  # more of them than may be sent
            m.setattr(learn, "FEW_PARAMS", 2)
            assert {r.row_id: r.rate for r in lookup(df, rates, ["source"], "rate", 0.5, "n").collect()} == {1: 0.1, 2: 0.2, 3: 0.3, 4: 0.5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
