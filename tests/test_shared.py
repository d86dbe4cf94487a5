"""Several tables on shared entities, strangers that come twice, and draws from very large groups."""

import numpy as np
from pyspark.sql import functions as F

from tablemend.functions.expr import uniform
from tablemend.operators.choose import sample
from tablemend.operators.link import LinkModel
from tablemend.plans.nested import Nested, clean_tables
from tablemend.session import scratch_path
from tablemend.streaming.stream import LinkStream, arriving


def test_draws_from_a_group_with_many_candidates(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": 3000, "two": 2, "one": 1, None: 5}
    rows, cuts = [], {}
    for g, n in groups.items():
        hi = np.round(np.cumsum(rng.dirichlet(np.full(n, 0.05))), 9)
        lo = np.append(0.0, hi[:-1])
        cuts[g] = lo, hi
        rows += [(g, f"o{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(lo, hi))]
    intervals = spark.createDataFrame(rows, "g string, option string, lo double, hi double")
    records = spark.createDataFrame([(i, ["hot", "hot", "two", "one", None, "none"][i % 6]) for i in range(6000)], "id long, g string")
    drawn = records.select("id", "g", (uniform("t", "id") * 0.999999998).alias("u")).collect()
    want = {}
    for r in drawn:
        if r.g == "none":
            want[r.id] = None
            continue
        lo, hi = cuts[r.g]
        hit = np.flatnonzero((lo <= r.u) & (r.u < hi))
        want[r.id] = f"o{hit[0]}" if len(hit) else None
    got = sample(records, "id", intervals, ["g"], "t")
    assert {r.id: r.option for r in got.collect()} == want and got.columns == ["id", "g", "option"]
    # A record meets few intervals, not those of its whole group.
    cells = intervals.where("g = 'hot' and hi > lo").select(F.floor(F.col("hi") * 3000) - F.floor(F.col("lo") * 3000) + 1).groupBy().sum().first()[0]
    assert cells <= 2 * 3000
    lone = intervals.where("g = 'two'").drop("g")
    assert {r.option for r in sample(records, "id", lone, [], "t").collect()} <= {"o0", "o1"}
    assert sample(records, "id", intervals.limit(0), ["g"], "t").where("option is not null").count() == 0


def test_strangers_of_two_batches_become_one(spark):
    path = scratch_path(spark)
    m = LinkModel("nation", ("region",))
    entities = spark.createDataFrame([("n1", "norway", "europe", 50)], "entity_id string, nation string, region string, n long")
    batches = [[("a", "norway", "europe"), ("b", "mozambique", "africa")] + [(f"c{i}", "mozambique", "africa") for i in range(9)], [("d", "mozambiqeu", "africa"), ("e", "mozmbique", "africa"), ("f", "paraguay", "america")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "row_id string, nation string, region string").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = arriving(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema)
    linker = LinkStream(spark, m, entities, f"{path}/state")
    links = linker.run(stream)
    out = {r.row_id: r.entity_id for r in linker.merged(links).collect()}
    assert len(out) == 14 and out["a"] == "n1"
    assert len({out["b"], out["d"], out["e"], out["c0"]}) == 1 and out["f"] not in (out["b"], "n1")


def test_tables_with_clashing_columns(spark):
    cls = Nested("Nation", ("nation",), (Nested("Region", ("region",)),))
    people = spark.createDataFrame([(i, "norway" if i else "norwya", "europe", "x") for i in range(20)] + [(20, None, "europe", "x")], "row_id int, home string, region string, nation string")
    firms = spark.createDataFrame([("p", "norwy", 1), ("q", "norway", 2), ("r", None, 3)], "row_id string, value string, Nation_id int")
    out = clean_tables({"people": people, "firms": firms}, {"people": {"home": "nation", "region": "region"}, "firms": {"value": "nation"}}, cls)
    got = out.flat["people"].collect()
    assert {r.home for r in got} == {"norway"} and {r.nation for r in got} == {"x"} and out.flat["people"].schema == people.schema
    assert {r.row_id: (r.value, r.Nation_id) for r in out.flat["firms"].collect()} == {"p": ("norway", 1), "q": ("norway", 2), "r": ("norway", 3)}
    assert out.tables["Nation"].collect()[0].n == 24 and out.links.count() == 24
