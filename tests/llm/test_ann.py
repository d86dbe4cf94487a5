"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemend.llm import ann


def brute(rows, queries, top):
    x = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)
        out[q] = d[:top]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, list int, score double")


def got_of(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("clusters", [1, 40])
def test_recall(spark, clusters):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(clusters, 24)) * 3
    x = (centres[rng.integers(0, clusters, 4000)] + rng.normal(size=(4000, 24))).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(4000)]
    df = frame(spark, rows)
    got = got_of(ann.neighbours(df, F.col("vec_id") % 100 == 0, list_size=50, block=128))
    want = brute(rows, range(0, 4000, 100), 10)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 10 * len(want)
    for q, found in got.items():
        assert len(found) == 10 and all(abs(s - float(np.sqrt(((x[i].astype(float) - x[q]) ** 2).sum()))) < 1e-12 for s, i in found)


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    graph = ann.Graph(rng.normal(size=(900, 8)))
    x = rng.normal(size=(200, 8))
    ids, d = graph.search(x, 32)
    true = np.argsort(ann._squared(x, graph.centroids), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(ids, true, strict=True)]) > 9.5
    assert (np.diff(d, axis=1) >= 0).all() and all(len(set(a)) == len(a) for a in ids)


def test_ties_and_a_hot_vector(spark):
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot) for i in range(0, 700)] + [(i, [float(i), 1.0, 0.5]) for i in range(700, 1000)]
    got = got_of(ann.neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0, list_size=100, block=64))
    assert set(got) == set(range(0, 1000, 100))
    for q in range(0, 700, 100):
        assert got[q] == [(0.0, i) for i in range(11) if i != q][:10]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0, 1.0]), (8, []), (None, [1.0, 1.0]), (100, [2.0, 0.0]), (200, None), (1, [0.0, 1.0])]
    got = got_of(ann.neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert got == {0: [(1.0, 100), (2**0.5, 1)], 100: [(1.0, 0), (5**0.5, 1)]}
    for few in ([], [(2, None)], [(0, [1.0])]):
        assert ann.neighbours(frame(spark, few), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e12])
def test_any_scale(spark, scale):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8)) * scale
    rows = [(i, x[i].tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = got_of(ann.neighbours(df, F.col("vec_id") % 100 == 0, list_size=4, block=128))
    want = brute(rows, range(0, 3000, 100), 10)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
