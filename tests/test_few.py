"""Typo pairs and nested links take the same decisions whatever way they are found."""

import random

import pytest
from pyspark.sql import functions as F

from tablemend.operators import candidates, link
from tablemend.plans import jobs, nested
from tablemend.session import cut_lineage


def _typo(rng, w):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abxyz") + w[i:], w[:i] + rng.choice("abxyz") + w[i + 1:]])


def test_a_small_side_is_broadcast_with_the_same_pairs(spark):
    rng = random.Random(3)
    words = ["large gear", "small plate", "a word of more than twenty letters", "", "ab"]
    seen = [None, *words, *(_typo(rng, _typo(rng, w)) for w in words * 30 if w)]
    o, w = spark.createDataFrame([(x,) for x in seen], "observed string"), spark.createDataFrame([(x,) for x in words], "word string")
    got = [sorted(map(tuple, candidates.by_segments(o, w, 2, (), small).collect())) for small in (None, "words", "observed")]
    assert got[0] == got[1] == got[2] and len(got[0]) > len(words)
    assert candidates.few(o, w, 2) == "words" and candidates.few(o, w, 3) is None


def test_few_words_bring_no_sorted_key_tables(spark):
    o = cut_lineage(spark.range(5000).select(F.col("id").cast("string").alias("observed")))
    w = spark.createDataFrame([("12",), ("34",)], "word string")
    plan = link.typo_pairs(o, w, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_v" not in plan and "BroadcastHashJoin [_v" in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_a_repair_reads_its_decisions_once(spark, seed, monkeypatch):
    """Spellings of all ranges of support end where a full search puts them, and the join has them written."""
    rng, rows = random.Random(seed), []
    for w, n in (("large gear", 400), ("small plate", 90), ("cold rod", 12), ("warm bolt", 1)):
        rows += [w] * n + [_typo(rng, w) for _ in range(n // 5)] + [_typo(rng, _typo(rng, w)) for _ in range(n // 8)]
    df = spark.createDataFrame(list(enumerate([*rows, None])), "row_id long, name string")
    written = []
    monkeypatch.setattr(jobs, "cut_lineage", lambda x: written.append(x.columns) or cut_lineage(x))
    got = {r.name: r.repaired for r in jobs.repair_typos(df, "name", max_typos=2).collect()}
    assert ["name", "c", "repaired", "score"] in written
    m = link.LinkModel("name")
    tups = link.tuples(df, m)
    kept = {r.name for r in link.seed_entities(tups, m).collect()}
    assert {"large gear", "small plate", "cold rod"} <= kept and set(got.values()) - {None} <= kept | {n for n in got}
    assert got[None] is None and got["large gear"] == "large gear"


def test_best_entities_of_the_first_class_equal_the_listed_ones(spark):
    rng = random.Random(5)
    cls = nested.Nested("Shop", ("name",), (nested.Nested("Town", ("town",)),))
    shops = [("blue shop", "NORTH_1"), ("green shop", "NORTH_2"), ("blue shop", "SOUTH_1"), ("old shop", "NORTH_1")]
    cells = {tuple(None if rng.random() < 0.1 else _typo(rng, c) if rng.random() < 0.3 else c for c in rng.choice(shops)) for _ in range(80)}
    tups = cut_lineage(spark.createDataFrame([(*c, 2) for c in cells], "name string, town string, c long"))
    towns = [(t, t, 60) for t in ("NORTH_1", "NORTH_2", "SOUTH_1")]
    tables = {
        "Town": spark.createDataFrame(towns, "entity_id string, town string, n long"),
        "Shop": spark.createDataFrame([(f"{i}", *s, 40 + i) for i, s in enumerate([*shops, ("old shop", None)])], "entity_id string, name string, Town_id string, n long"),
    }
    found = []
    for top in (True, False):
        best = nested._message(cls, tups, tables, 2, nested.Prior(), top).best
        found.append(sorted(map(repr, best.withColumn("score", F.round("score", 5)).collect())))
    assert found[0] == found[1] and len(found[0]) == len(cells)
