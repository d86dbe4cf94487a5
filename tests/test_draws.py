"""Draws against the distributions they stand for."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemend.functions import draws
from tablemend.operators import learn

N = 20_000


def farthest(sample, exact):
    """Largest gap between the sample's distribution and a very large one of numpy's."""
    sample, exact = np.sort(sample), np.sort(exact)
    at = np.concatenate([sample, exact])
    return np.abs(np.searchsorted(sample, at, "right") / len(sample) - np.searchsorted(exact, at, "right") / len(exact)).max()


def test_distributions(spark):
    keys = spark.range(N)
    shapes = [0.05, 0.5, 1.0, 3.5, 400.0]
    columns = [draws.gamma(F.lit(a), f"g{i}", "id").alias(f"g{i}") for i, a in enumerate(shapes)]
    got = keys.select(draws.normal("z", "id").alias("z"), draws.beta(F.lit(10.0), F.lit(50.0), "b", "id").alias("b"), draws.beta(F.lit(0.5), F.lit(2.0), "c", "id").alias("c"), *columns).toPandas()
    rng = np.random.default_rng(1)
    bound = 1.95 * math.sqrt(1 / N + 1 / (20 * N))  # one in a thousand
    assert farthest(got.z, rng.normal(size=20 * N)) < bound
    assert farthest(got.b, rng.beta(10, 50, 20 * N)) < bound and farthest(got.c, rng.beta(0.5, 2, 20 * N)) < bound
    for i, a in enumerate(shapes):
        assert farthest(got[f"g{i}"], rng.gamma(a, size=20 * N)) < bound
    assert abs(np.corrcoef(got.z, got.g3)[0, 1]) < 0.03


def test_draws_repeat_and_seeds_differ(spark):
    df = spark.createDataFrame([("a", 3, 10), ("b", 0, 0), (None, 1, 1)], "s string, errors long, matches long")
    one, two, other = (sorted(map(str, learn.sample_rates(df.repartition(k), "s", seed=seed).collect())) for k, seed in ((1, 7), (3, 7), (1, 8)))
    assert one == two != other and len(one) == 3


def test_weights_sum_to_one_and_follow_their_prior(spark):
    options = spark.createDataFrame([(g, o, w) for g in range(3000) for o, w in (("x", 6.0), ("y", 3.0), ("z", 1.0))], "g int, option string, w double")
    counts = spark.createDataFrame([(0, "z", 10_000)], "g int, option string, n long")
    p = learn.sample_proportions(counts, options, learn.Dirichlet("w"), by=["g"])
    rows = p.groupBy("g").agg(F.sum("p").alias("t")).select(F.min("t"), F.max("t")).first()
    assert rows[0] == pytest.approx(1) and rows[1] == pytest.approx(1)
    means = {r.option: r.m for r in p.where("g > 0").groupBy("option").agg(F.avg("p").alias("m")).collect()}
    assert means == {"x": pytest.approx(0.6, abs=0.02), "y": pytest.approx(0.3, abs=0.02), "z": pytest.approx(0.1, abs=0.02)}
    assert p.where("g = 0 and option = 'z'").first()["p"] > 0.99
    fixed = {r.option: r.p for r in learn.learn_proportions(counts, options.where("g = 0"), learn.Dirichlet("w"), by=["g"]).collect()}
    assert fixed == {"x": pytest.approx(6 / 10010), "y": pytest.approx(3 / 10010), "z": pytest.approx(10001 / 10010)}


def test_means(spark):
    stats = spark.createDataFrame([(k, 2.0, 4, 40.0) for k in range(5000)], "k long, std double, n long, sum double")
    got = learn.sample_means(stats, learn.NormalMean(0.0, 1.0), "std", ["k"]).toPandas()["mean"]
    assert got.mean() == pytest.approx(5.0, abs=0.05) and got.std() == pytest.approx(math.sqrt(0.5), abs=0.03)
