"""The stream's stored candidate index: what it holds, what a batch adds to it, and what replays and restarts leave."""

import os
import random

from pyspark.sql import functions as F

from tablemend.operators.candidates import word_keys
from tablemend.operators.link import LinkModel, link, tuples
from tablemend.session import scratch_path
from tablemend.streaming.stream import LinkStream, replaced, stretches

M = LinkModel("name", ("kind",), max_typos=1)
ROWS = "row_id string, name string, kind string"
BATCHES = 6


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([4, 6, 9, 26]))) for _ in range(n)]


def batches(rng, known):
    out, seen = [], list(known)
    for b in range(BATCHES):
        fresh = [] if b == 3 else words(rng, 4)
        seen += fresh
        rows = [rng.choice(seen) for _ in range(12)] + fresh
        rows = [w[1:] if rng.random() < 0.3 else w for w in rows] + [None]
        out.append([(f"{b}-{i}", w, rng.choice(["x", None])) for i, w in enumerate(rows)])
    return out


def test_stretches_are_few_and_whole():
    for n in range(200):
        got = stretches(n)
        assert [i for a, b in got for i in range(a, b)] == list(range(n)) and len(got) <= max(1, n.bit_length())
        if n and (gone := replaced(n)):
            assert (gone[0][0], gone[-1][1]) == got[-1] and set(gone[:-1]) <= set(stretches(n - 1))


def test_index_replays_and_restarts(spark):
    rng = random.Random(11)
    known = words(rng, 10)
    entities = spark.createDataFrame([(f"e{i}", w, "x", 3) for i, w in enumerate(known)], "entity_id string, name string, kind string, n int")
    path = scratch_path(spark)
    keys = lambda at: f"{path}/keys/{at}-{at + 1}"
    shown = 0
    for b, rows in enumerate(batches(rng, known)):
        shown += len(rows)
        job = LinkStream(spark, M, entities, path)  # a new driver for every batch
        batch = spark.createDataFrame(rows, ROWS)
        before = {tuple(r) for r in job.entities(b).collect()}
        want = {tuple(r) for r in link(tuples(batch, M), job.entities(b), job.prior(b)).select(*M.fields, "entity_id", "is_new").collect()}
        for _ in range(2 if b in (1, 2, 4) else 1):  # merges of keys and states among the replayed ones
            job.process(batch, b)
            links = spark.read.parquet(f"{path}/links/batch={b}")
            assert links.count() == len(rows)
            # The stored index finds what a search over all entities finds.
            assert {tuple(r) for r in links.select(*M.fields, "entity_id", "is_new").distinct().collect()} == want
            # A batch writes the keys of the names it opened and no others.
            opened = links.where("is_new").select(F.col("name").alias("word")).distinct()
            assert {tuple(r) for r in spark.read.parquet(keys(b)).collect()} == {tuple(r) for r in word_keys(opened, 1).collect()}
        assert {tuple(r) for r in job.entities(b).collect()} == before
    job = LinkStream(spark, M, entities, path)
    final = job.state()
    names = final.select(F.col("name").alias("word")).distinct()
    assert {tuple(r) for r in job.index(BATCHES).distinct().collect()} == {tuple(r) for r in word_keys(names, 1).collect()}
    assert final.groupBy().sum("n").first()[0] == 30 + shown
    # What was replaced is gone: the last compaction and what the next merge needs are left.
    assert set(os.listdir(f"{path}/state")) == {"before=4", "before=6"}
    assert set(os.listdir(f"{path}/keys")) == {"first", "0-4", "4-5", "5-6", "4-6"}


def test_empty_batches_and_no_entities(spark):
    none = spark.createDataFrame([], "entity_id string, name string, kind string, n int")
    job = LinkStream(spark, M, none, scratch_path(spark), refresh=1)
    job.process(spark.createDataFrame([], ROWS), 0)
    job.process(spark.createDataFrame([("a", "alpha", "x"), ("b", "alpha", "x"), ("c", None, None)], ROWS), 1)
    job.process(spark.createDataFrame([("d", "alpa", None)], ROWS), 2)
    assert sorted((r.name, r.n) for r in job.state().collect() if r.name) == [("alpha", 3)]
    assert job.state().count() == 2


def test_arrivals_are_written_by_many_tasks_in_four_batches(spark, sf, monkeypatch):
    import os

    from tablemend.plans import catalog

    seen = {}
    rows = spark.range(5000).selectExpr("md5(cast(id as string)) row_id", "id")
    monkeypatch.setattr(catalog.fx, "claims", lambda spark, d: rows)
    monkeypatch.setattr(catalog.stream, "arriving", lambda spark, path, schema, files_per_batch=1: seen.update(path=path, each=files_per_batch))
    monkeypatch.setattr(catalog.stream, "stream_error_rate", lambda *a: None)
    catalog.stream_error_rate(spark, sf)
    files = [f for f in os.listdir(seen["path"].removeprefix("file:")) if f.startswith("part-")]
    assert len(files) >= 128 and -(-len(files) // seen["each"]) == 4
