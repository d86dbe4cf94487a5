import random

import pytest
from pyspark.sql import functions as F

from tablemend.functions import models
from tablemend.operators import inject, learn
from tablemend.plans import catalog, fixtures, model
from tablemend.plans.jobs import impute
from tablemend.plans.model import Column, EntityClass, clean
from tablemend.plans.recipes import clean_claims, clean_listings
from tablemend.session import cut_lineage


def share(df, a, b):
    return df.select(F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int"))).first()[0]


def test_joint_repair_recovers_truth(spark, sf):
    r = cut_lineage(fixtures.part_records(spark, sf))
    out = clean(r, catalog.PART, catalog.PART_COLUMNS)
    for c, floor in [("number", 0.98), ("name", 0.99), ("brand", 0.98), ("type", 0.99)]:
        assert share(out.flat, c, f"true_{c}") >= floor > share(r, c, f"true_{c}")
    assert out.flat.count() == out.links.count() == r.count()
    part, kind = out.tables["Part"], out.tables["PartType"]
    assert part.select(F.sum("n")).first()[0] == r.count()
    assert part.where("type_id is not null").join(kind, part.type_id == kind.entity_id, "left_anti").count() == 0
    assert kind.count() == 6


def test_clean_input_stays_as_it_is(spark):
    rows = [(str(i), f"hospital {'abcdefghij'[i % 10] * 5}", f"town {'uvwxy'[i % 5] * 4}") for i in range(300)]
    df = spark.createDataFrame(rows, "row_id string, name string, town string")
    cls = EntityClass("Hospital", ["name"], [["name"]], {"loc": EntityClass("Place", ["town"], [["town"]])})
    out = clean(df, cls, {"name": Column("name"), "town": Column("loc.town")})
    assert out.flat.exceptAll(df).count() == 0 and df.exceptAll(out.flat).count() == 0
    assert out.tables["Hospital"].count() == 10 and out.tables["Place"].count() == 5


def test_entities_that_share_a_key_are_not_all_met(spark, monkeypatch):
    rng, rows = random.Random(5), []
    number = {i: f"{1000 + i}" for i in range(240)}
    for i in number:  # 40 to 80 entities share each (name, kind)
        name, kind = ("red kettle", "blue pillow")[i % 2], ("large", "small", "medium")[i % 3 if i % 2 else 0]
        for _ in range(rng.randint(2, 6)):
            shown = name if rng.random() < 0.7 else name[:3] + rng.choice("xyz") + name[4:]
            rows.append((str(len(rows)), number[i] if rng.random() < 0.8 else rng.choice([None, "77777"]), shown if rng.random() < 0.9 else None, kind, rng.choice(["Oslo", "Osla", "Rome", None])))
    df = spark.createDataFrame(rows, "row_id string, number string, name string, kind string, town string")
    cls = EntityClass("Item", ["number", "name", "kind", "town"], [["number"], ["name", "kind"]])
    columns = {"number": Column("number", typos=False), "name": Column("name"), "kind": Column("kind", typos=False), "town": Column("town")}
    met, score = [], model._score
    monkeypatch.setattr(model, "_score", lambda candidates, *rest: met.append(candidates.count()) or score(candidates, *rest))

    def cleaned():
        out = clean(df, cls, columns, sweeps=2)
        return sorted(map(tuple, out.links.collect())), sorted(map(repr, out.flat.collect()))

    few = cleaned()
    monkeypatch.setattr(model, "TOLD_APART_BY", -1)  # every entity of a key, as the definition says
    assert few == cleaned()
    assert met[0] * 3 < met[2] and met[0] < 10 * len(rows)


def test_columns_of_any_name(spark):
    rows = [(str(i), f"hospital {'abcdefghij'[i % 10] * 5}", f"town {'uvwxy'[i % 5] * 4}", i, "x", "y") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id string, name string, _1 string, entity_id int, _0 string, value string")
    cls = EntityClass("Hospital", ["name"], [["name"]], {"loc": EntityClass("Place", ["town"], [["town"]])})
    out = clean(df, cls, {"name": Column("name"), "_1": Column("loc.town")}).flat
    assert out.columns == df.columns and out.exceptAll(df).count() == 0
    claims = spark.createDataFrame([(1, "s", "a", "q"), (1, "t", "a", "q"), (1, "u", "b", "q")], "flight int, src string, dep string, _0 string")
    assert {tuple(r) for r in clean_claims(claims, "flight", "src", ["dep"])[0].collect()} == {(1, s, "a", "q") for s in "stu"}


def test_rows_without_a_group_are_one(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, None, "a"), (4, "g", "b"), (5, "g", "b"), (6, "g", "b"), (7, "g", None), (8, "h", None)], "row_id int, g string, v string")
    got = {r.row_id: r.v for r in impute(df, "v", ["g"]).collect()}
    assert got == {1: "a", 2: "a", 3: "a", 4: "b", 5: "b", 6: "b", 7: "b", 8: "b"}


def test_claims_of_several_fields(spark):
    rng = random.Random(7)
    rate = {f"s{i}": (0.05 if i < 4 else 0.5) for i in range(8)}
    truth = {(e, f): f"{rng.randint(1, 12)}:{rng.randint(10, 59)} a.m." for e in range(60) for f in ("dep", "arr")}
    rows = []
    for e in range(60):
        for s, p in rate.items():
            shown = [rng.choice(["1:11 a.m.", "2:22 p.m.", "3:33 a.m."]) if rng.random() < p else truth[e, f] for f in ("dep", "arr")]
            rows.append((e, s, None if rng.random() < 0.1 else shown[0], shown[1], "kept"))
    df = spark.createDataFrame(rows, "flight int, src string, dep string, arr string, note string")
    fixed, rates = clean_claims(df, "flight", "src", ["dep", "arr"], rounds=3)
    got = fixed.select("flight", "dep", "arr", "note").distinct().collect()
    assert len(got) == 60
    assert sum((r.dep == truth[r.flight, "dep"]) + (r.arr == truth[r.flight, "arr"]) for r in got) >= 116
    learned = {r.src: r.rate for r in rates.collect()}
    assert max(learned[f"s{i}"] for i in range(4)) < min(learned[f"s{i}"] for i in range(4, 8))


def test_listings(spark):
    rng = random.Random(9)
    counties = [("Orange County", "CA"), ("Kings County", "NY"), ("Travis County", "TX")]
    rows = []
    for i in range(600):
        name, st = counties[i % 3]
        amount = round(rng.gauss(1200 + 300 * (i % 3), 60), 0)
        shown = amount / 1000 if rng.random() < 0.2 else amount
        rows.append((i, name, name, name[0] + name.split()[0][-1], None if rng.random() < 0.2 else st, st, "1br", shown, amount))
    df = spark.createDataFrame(rows, "row_id int, true_county string, county string, k string, st string, true_st string, kind string, rent double, true_rent double")
    dirty = inject.typos(df, "true_county", "county")
    out = cut_lineage(clean_listings(dirty, "k", "county", "st", "kind", "rent", max_typos=2))
    assert share(out, "county", "true_county") > 0.99 and share(out, "st", "true_st") == 1.0
    assert share(out, "rent", "true_rent") == 1.0


def test_own_models_and_parameters(spark):
    df = spark.createDataFrame([("a", "a", 1), ("b", "a", 1), (None, "a", 2)], "obs string, v string, g int")
    coin = models.ErrorModel("coin", lambda o, v: F.when(F.col(o) == F.col(v), F.lit(-0.1)).otherwise(F.lit(-2.0)))
    assert [r.loglik for r in coin.score(df, "obs", "v").orderBy("g", "obs").collect()] == [-0.1, -2.0, -2.0]
    assert not models.TYPOS.enumerable and models.TYPOS.observes_missing and models.TIME.enumerable

    class Share:
        def stats(self, observed, value, weight=None):
            return [F.count_if(F.col(observed).isNull()).alias("gaps"), F.count("*").alias("n")]

        def posterior(self):
            return F.col("gaps") / F.col("n")

    got = {r.g: r.parameter for r in learn.learn(df, Share(), "obs", "v", ["g"]).collect()}
    assert got == {1: 0.0, 2: 1.0}
    assert learn.learn(df, learn.Beta(1, 3), "obs", "v").first()["parameter"] == pytest.approx(2 / 6)
