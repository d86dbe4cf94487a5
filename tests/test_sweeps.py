"""Full sweeps: parameters learned, entities opened, and nothing left behind."""

import os

import pytest

from tablemend.operators.link import LinkModel
from tablemend.plans import fixtures, jobs
from tablemend.session import cut_lineage, scratch_path

M = LinkModel("nation", ("region",))


def folders(spark):
    top = os.path.dirname(scratch_path(spark)).removeprefix("file://")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_disk_and_lineage_stay_flat(spark, sf):
    records = cut_lineage(fixtures.customers_flat(spark, sf).select("row_id", "nation", "region"))
    left, plans, scores = [], [], []
    for rounds in (1, 5):
        before = folders(spark)
        out = jobs.sweeps_learned(records, M, rounds)
        left.append(len(folders(spark) - before))
        plans.append(len(out.links._jdf.queryExecution().analyzed().toString()))
        scores.append([p["score"] for p in out.progress])
        assert [p["sweep"] for p in out.progress] == list(range(1, rounds + 1))
        assert {p["records"] for p in out.progress} == {150}
    assert left[0] == left[1] == 3 and abs(plans[0] - plans[1]) < 50
    assert scores[0][0] == pytest.approx(scores[1][0])
    sizes = out.links.groupBy("entity_id").sum("c").collect()
    assert sum(r[1] for r in sizes) == 150


def test_a_stranger_opens_an_entity_and_names_may_be_missing(spark):
    rows = [(f"a{k}", "norway", "europe") for k in range(30)] + [(f"b{k}", "norwya", "europe") for k in range(2)] + [("c", "mozambique", "africa"), ("d", None, "africa"), ("e", None, None)]
    records = spark.createDataFrame(rows, "row_id string, nation string, region string")
    out = jobs.sweeps_learned(records, M, 3)
    entities = {r.entity_id: (r.nation, r.region) for r in out.entities.collect()}
    found = {r.row_id: entities.get(r.entity_id) for r in jobs.repaired_fields(records, out.links, out.entities, M).collect()}
    assert found["a0"] == found["b0"] == ("norway", "europe") and found["c"] == ("mozambique", "africa")
    assert len(found) == len(rows) and out.model.strength in (0.5, 1.0, 2.0, 4.0)
    assert jobs.sweeps_learned(records.limit(0), M, 1).links.count() == 0


def test_names_are_compared_once_for_all_rounds(spark, monkeypatch):
    from tablemend.operators import link

    calls = []
    real = link.name_options
    monkeypatch.setattr(link, "name_prior", lambda tups, m, real=link.name_prior: calls.append(1) or real(tups, m))
    records = spark.createDataFrame([(f"a{k}", "norway", "europe") for k in range(9)] + [("b", "norwya", "europe")], "row_id string, nation string, region string")
    out = jobs.sweeps_learned(records, M, 3)
    assert len(calls) == 2  # one for the seeds, one for the new-entity branch of all rounds
    tups = cut_lineage(link.tuples(records, M))
    with_own = link.relink(tups, out.entities, out.model, None, real(tups, M))
    assert sorted(map(str, with_own.collect())) == sorted(map(str, link.relink(tups, out.entities, out.model).collect()))
