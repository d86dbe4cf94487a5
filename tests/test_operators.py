import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tablemend.operators import candidates, choose, domains, evaluate, inject, learn, link, prepare
from tablemend.operators import spread
from tablemend.operators.spread import spread_join
from tablemend.plans import jobs
from tablemend.sources import sinks, tables


def words(rng, n, size=(4, 14)):
    return ["".join(rng.choice("abcd") for _ in range(rng.randint(*size))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 2])
def test_candidates_equal_brute_force(spark, k):
    rng = random.Random(k)
    base = words(rng, 150)
    observed = base + [w[: i % len(w)] + "x" + w[i % len(w):] for i, w in enumerate(base)] + ["", "a", "ab"]
    o = spark.createDataFrame([(w,) for w in observed], "observed string")
    w = spark.createDataFrame([(x,) for x in base + ["", "b"]], "word string")
    got = {f.__name__: {(r.observed, r.word, r.k) for r in f(o, w, k).collect()} for f in (candidates.by_deletion, candidates.by_segments)}
    odf, wdf = o.toPandas(), w.toPandas()  # noqa: F841
    want = set(duckdb.sql(
        f"select distinct observed, word, damerau_levenshtein(observed, word)::int k from odf, wdf where damerau_levenshtein(observed, word) <= {k}"
    ).fetchall())
    assert got["by_deletion"] == want
    assert got["by_segments"] == want


def test_candidate_plans_are_equi_joins(spark):
    o = spark.createDataFrame([("ab",)], "observed string")
    w = spark.createDataFrame([("ab",)], "word string")
    for f in (candidates.by_deletion, candidates.by_segments):
        plan = f(o, w, 2)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_truth_discovery_equals_product_of_claims_and_options(spark):
    # One entity holds a third of all rows.
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randint(1, 40), rng.choice("abcde")) for i in range(3000)]
    df = spark.createDataFrame(rows, "e int, claim string")
    got = {r.e: (r.value, r.posterior) for r in jobs.truth_discovery(df, ["e"]).collect()}
    for e in {r[0] for r in rows}:
        claims = [c for x, c in rows if x == e]
        opts = sorted(set(claims))
        score = {o: sum(math.log(0.9) if c == o else math.log(0.1) - math.log(len(opts)) for c in claims) for o in opts}
        best = min(opts, key=lambda o: (-round(score[o], 6), o))
        total = sum(math.exp(s - score[best]) for s in score.values())
        assert got[e][0] == best and got[e][1] == pytest.approx(1 / total, rel=1e-6)


def test_posteriors_sum_to_one_also_for_missing_keys(spark):
    df = spark.createDataFrame([("a", 1, -1.0), ("a", 2, -2.0), (None, 3, -500.0), (None, 4, -501.0)], "k string, c int, s double")
    sums = {r.k: r.t for r in choose.posterior(df, ["k"], "s").groupBy("k").agg(F.sum("p").alias("t")).collect()}
    assert sums == {"a": pytest.approx(1.0), None: pytest.approx(1.0)}


def test_learned_parameters(spark):
    counts = spark.createDataFrame([("x", 5), ("y", 3), ("z", 2)], "option string, n int")
    p = {r.option: r.p for r in learn.learn_proportions(counts, counts).collect()}
    assert p == {"x": pytest.approx(0.461538, abs=1e-6), "y": pytest.approx(0.307692, abs=1e-6), "z": pytest.approx(0.230769, abs=1e-6)}
    rate = learn.learn_error_rate(spark.createDataFrame([(3, 17)], "errors long, matches long"), learn.Beta(10, 50)).first().rate
    assert rate == pytest.approx(0.1625)
    stats = spark.createDataFrame([(1, 150.0, 4, 6400.0)], "g int, std double, n int, sum double")
    assert learn.learn_mean(stats, learn.NormalMean(1500, 1000), "std", ["g"]).first()["mean"] == pytest.approx(1599.440646, abs=1e-6)
    assert learn.NormalMean(-10).spread == 5 and learn.Beta.odds(0.25) == learn.Beta(1.0, 3.0)


def test_py_score_reference_index(spark):
    refs = spark.createDataFrame([(5,), (1,), (3,)], "n int")
    got = {r.discount: r.score for r in learn.py_scores(refs, [2.0], [0.0, 0.5], first_index=1).collect()}
    for d in (0.0, 0.5):
        score, seen = 0.0, 0
        for i, n in enumerate([5, 1, 3], 1):
            score += math.log(i * d + 2) - math.log(seen + 2) + sum(math.log(j - d) - math.log(seen + j + 2) for j in range(1, n))
            seen += n
        assert got[d] == pytest.approx(score, abs=1e-9)


def test_accuracy_micro_fixture(spark):
    rows = [(1, "a", "a", "a"), (2, "b", "c", "c"), (3, "d", "e", "d"), (4, "f", "f", "g"), (5, None, "h", "h")]
    df = spark.createDataFrame(rows, "row_id int, dirty string, clean string, ours string")
    side = [df.select("row_id", F.col(c).alias("v")) for c in ("dirty", "clean", "ours")]
    r = evaluate.accuracy(*side, ["v"]).first()
    assert (r.errors, r.changed, r.cleaned, r.imputed, r.correctly_imputed) == (2, 2, 1, 1, 1)
    assert (r.precision, r.recall, r.f1) == (pytest.approx(2 / 3),) * 3
    report = {(x.kind, x.dirty, x.ours, x.clean) for x in evaluate.error_report(*side, ["v"]).collect()}
    assert report == {("left", "d", "d", "e"), ("changed", "f", "g", "f")}
    unmapped = evaluate.accuracy(*side, []).first()
    assert unmapped.errors == 2 and unmapped.changed == 0 and unmapped.f1 is None


def test_position_is_a_permutation_in_key_order(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 3).alias("g"))
    pdf = prepare.position(df, "h", prefix=1).toPandas().sort_values("h")
    assert list(pdf["row_no"]) == list(range(1, 501))
    by = prepare.position(df, "h", prefix=1, by=["g"]).toPandas().sort_values("h")
    assert all(list(x["row_no"]) == list(range(1, len(x) + 1)) for _, x in by.groupby("g"))


def test_sweep_on_clean_data_changes_nothing(spark):
    rows = [(i, f"place number {'abcdefgh'[i % 8] * 4}", "north" if i % 2 else "south") for i in range(400)]
    df = spark.createDataFrame(rows, "row_id int, nation string, region string")
    m = link.LinkModel("nation", ("region",))
    links, entities = jobs.sweeps(df, m, 1)
    fixed = jobs.repaired_fields(df, links, entities, m)
    assert evaluate.repair_log(df, fixed, ["nation", "region"]).count() == 0
    assert entities.select(F.sum("n")).first()[0] == 400
    assert entities.join(links, "entity_id", "left_anti").count() == 0
    assert links.join(entities, "entity_id", "left_anti").count() == 0


def test_result_does_not_depend_on_partitioning(spark):
    rng = random.Random(5)
    names = ["copper pipe", "steel bolt", "brass valve"]
    rows = [(i, rng.choice(names)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id int, v string")
    dirty = inject.typos(df, "v", "w").select("row_id", F.col("w").alias("v"))
    one = {r.row_id: r.repaired for r in jobs.repair_typos(dirty.repartition(1), "v", max_typos=2).collect()}
    many = {r.row_id: r.repaired for r in jobs.repair_typos(dirty.repartition(13).orderBy(F.rand(1)), "v", max_typos=2).collect()}
    assert one == many
    truth = dict(rows)
    assert sum(one[i] == truth[i] for i in truth) / 300 > 0.98


def test_text_prior_edges(spark):
    letters = domains.letter_bigrams(spark.createDataFrame([("abab",), ("ba.",)], "text string"))
    assert letters.count() == 29 * 28
    assert all(abs(r.t - 1) < 1e-9 for r in letters.groupBy("prev").agg(F.sum("p").alias("t")).collect())
    p = {r.word: r.logp for r in domains.text_prior(spark.createDataFrame([("ab",), ("a9",), ("abc",), ("",)], "word string"), letters, 0, 2).collect()}
    prob = {(r.prev, r.next): r.p for r in letters.collect()}
    assert p["ab"] == pytest.approx(-math.log(3) + math.log(prob["^", "a"]) + math.log(prob["a", "b"]))
    assert p["a9"] == pytest.approx(-math.log(3) + math.log(prob["^", "a"]) - math.log(28))
    assert p["abc"] == -1e9 and p[""] == pytest.approx(-math.log(3))


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x y"), (2, None)], "k int, `Room Type` string")
    df.write.option("header", True).csv(str(tmp_path / "in.csv"))
    back = tables.read_table(spark, str(tmp_path / "in.csv"), "k int, `Room Type` string")
    bound = tables.bind_observed(back, ["k"])
    assert bound.select("row_id").distinct().count() == 2
    assert prepare.align_columns(bound, {"Room Type": "br"}).columns == ["row_id", "br"]
    out = sinks.save_results(str(tmp_path), "demo", {"Obs": back}, {"County": df.withColumn("_n", F.lit(1))}, timestamp=False)
    saved = spark.read.option("header", True).csv(f"{out}/inferred_County")
    assert saved.columns == ["k", "Room Type"] and saved.count() == 2
    assert sinks.output_dir("d", "n") != "d/n"
    sinks.report_progress(spark, str(tmp_path / "progress"), 1, "links", rows=2)
    sinks.report_progress(spark, str(tmp_path / "progress"), 2, "links", rows=3)
    assert spark.read.json(str(tmp_path / "progress")).count() == 2


def test_attach_equals_plain_left_join(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 50}", i % 2) for i in range(3000)], "i int, k string, g int")
    table = spark.createDataFrame([("hot", 0, "h0"), ("k3", 1, "x"), (None, 0, "never"), ("absent", 0, "y")], "k string, g int, v string")
    got, want = spread.attach(rows, table, ["k", "g"]), rows.join(table, ["k", "g"], "left").select("i", "k", "g", "v")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 3000


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join_equals_plain_join(spark, how):
    # One key holds a third of all rows, one is missing, one is unknown to the table.
    rows = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % 5000).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("k is null or k <> 7")
    got = spread_join(rows, table, ["k"], "n", how)
    plain = rows.alias("r").join(table.alias("t"), F.col("r.k").eqNullSafe(F.col("t.k")), how).select("r.id", "r.k", "t.n", "t.first")
    assert got.columns == ["id", "k", "n", "first"]
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_long_words_with_common_parts_equal_brute_force(spark):
    rng = random.Random(5)
    base = [f"http{rng.choice(['s', ''])}://{rng.choice(['shop', 'm.news', 'a'])}{rng.randrange(99)}.example.com/{rng.choice('xyz') * rng.randrange(9)}{rng.randrange(200)}?source=feed" for _ in range(150)]

    def edited(w):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) - 1)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + "q" + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2:], w[:i] + "/" + w[i + 1:]])
        return w

    o = spark.createDataFrame([(edited(w), i % 2) for i, w in enumerate(base * 2)], "observed string, x long")
    w = spark.createDataFrame([(v, i % 2) for i, v in enumerate(base)], "word string, x long")
    for k in (1, 2):
        got = {tuple(r) for r in candidates.by_segments(o, w, k, ["x"]).select("x", "observed", "word", "k").collect()}
        every = o.distinct().join(w.distinct(), "x")
        assert got == {tuple(r) for r in candidates.within_bound(every, "observed", "word", k).select("x", "observed", "word", "k").collect()}
        assert len(got) > 100


def test_tables_of_keys_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(f"https://a.example.com/{i}",) for i in range(50)], "observed string").write.parquet(f"{tmp_path}/w")
    o = spark.read.parquet(f"{tmp_path}/w")
    for f in (candidates.by_deletion, candidates.by_segments):
        assert "Broadcast" not in f(o, o.withColumnRenamed("observed", "word"), 2)._jdf.queryExecution().executedPlan().toString()
