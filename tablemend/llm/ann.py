"""Approximate nearest neighbours with balanced posting lists.

* Centroids come from a bounded sample (``SAMPLE`` vectors at most, ``MAX_CENTROIDS`` lists at most)
  by k-means with a penalty on large lists.  They are all that is broadcast.
* A graph over the centroids, searched best first from a few entries, finds the ones near a vector.
* A vector is listed with its nearest centroid and, near a boundary, with others too: those at most
  ``CLOSURE`` times as far, unless a centroid already chosen is closer to them than the vector is.
* A query reads all lists whose centroid is at most ``ratio`` times as far as its nearest one.  The
  ratio is the one that finds ``AIM`` of the true neighbours of sampled vectors within the sample;
  neighbours in the whole table are nearer, so the share found there is at least about that.
* Lists and the queries on them are dealt out in blocks of bounded size, so a list that holds a
  third of all rows is many tasks' work.  Each block gives its nearest rows, and a last step picks
  among those.  Distances are computed in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.session import cut_lineage

SAMPLE = 20_000
MAX_CENTROIDS = 4096
LIST_SIZE = 1000
CLOSURE = 1.1
COPIES = 4  # lists a vector may be in
NEIGHBOURS = 16  # of a centroid in the graph
AIM = 0.97
BLOCK = 4096  # vectors of a list, and queries, that meet in one task at a time
SEED = 13


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means in which a full list looks farther away, so that lists come out of like size."""
    rng = np.random.default_rng(SEED)
    sample = np.unique(sample, axis=0)
    k = min(k, len(sample))
    centroids = sample[rng.choice(len(sample), k, replace=False)].copy()
    penalty = np.zeros(k)
    for _ in range(rounds):
        d = np.concatenate([_squared(part, centroids) for part in np.array_split(sample, max(1, len(sample) // 2000))])
        own = (d + penalty).argmin(axis=1)
        sizes = np.bincount(own, minlength=k)
        penalty = 0.5 * d.min(axis=1).mean() * (sizes * k / len(sample) - 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        used = sizes > 0
        centroids[used] = sums[used] / sizes[used, None]
    return np.unique(centroids, axis=0)


class Graph:
    """Each centroid's nearest others, and a search along those links."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        m = min(NEIGHBOURS, k - 1)
        d = _squared(centroids, centroids)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, :m]
        # Some far links, so that separate clusters are in one graph.
        far = np.random.default_rng(SEED).integers(0, k, (k, min(4, m)))
        self.links = np.concatenate([near, far], axis=1) if m else np.zeros((k, 0), np.int64)
        self.entries = np.linspace(0, k - 1, min(k, 8)).astype(np.int64)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``width`` centroids found for each row of ``x``, nearest first, and their distances."""
        k, n = len(self.centroids), len(x)
        width = min(width, k)
        if width == k:
            d = np.sqrt(_squared(x, self.centroids))
            ids = np.argsort(d, axis=1, kind="stable")
            return ids, np.take_along_axis(d, ids, 1)
        size = max(width, len(self.entries))
        ids = np.full((n, size), k, np.int64)
        ids[:, : len(self.entries)] = self.entries
        padded = np.vstack([self.centroids, np.full((1, x.shape[1]), np.inf)])
        d = ((padded[ids] - x[:, None, :]) ** 2).sum(-1)
        seen = np.zeros((n, k + 1), bool)
        seen[:, k] = True
        np.put_along_axis(seen, ids, True, 1)
        tried = ids == k
        live = np.arange(n)
        while len(live):
            step = np.where(tried[live], np.inf, d[live]).argmin(axis=1)
            going = ~tried[live, step]
            live, step = live[going], step[going]
            if not len(live):
                break
            tried[live, step] = True
            new = self.links[ids[live, step]]
            new = np.where(np.take_along_axis(seen[live], new, 1), k, new)
            seen[live[:, None], new] = True
            nd = ((padded[new] - x[live][:, None, :]) ** 2).sum(-1)
            all_ids, all_d = np.concatenate([ids[live], new], 1), np.concatenate([d[live], nd], 1)
            all_tried = np.concatenate([tried[live], new == k], 1)
            repeated = np.zeros_like(all_tried)  # a link may be listed twice
            order = np.argsort(all_ids, axis=1, kind="stable")
            by_id = np.take_along_axis(all_ids, order, 1)
            np.put_along_axis(repeated, order, np.concatenate([np.zeros((len(live), 1), bool), by_id[:, 1:] == by_id[:, :-1]], 1), 1)
            all_d = np.where(repeated, np.inf, all_d)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :size]
            ids[live], d[live], tried[live] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_d, all_tried | repeated))
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1))

    def within(self, x: np.ndarray, ratio: float, enough: np.ndarray, wanted: int) -> list[np.ndarray]:
        """For each row all centroids at most ``ratio`` times as far as the nearest, and as many more as
        it takes for ``enough`` of their list sizes to sum up to ``wanted``."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
        left, width = np.arange(len(x)), 32
        while len(left):
            ids, d = self.search(x[left], width)
            sums = np.cumsum(np.append(enough, 0)[ids], axis=1)
            take = np.maximum((d <= ratio * d[:, :1]).sum(1), (sums < wanted).sum(1) + 1)
            whole = ids.shape[1] == len(self.centroids)
            # The search may reach fewer centroids than asked for; then a wider one is due.
            reached = ids[np.arange(len(ids)), np.minimum(take, ids.shape[1]) - 1] < len(self.centroids)
            done = (take < ids.shape[1]) & reached | whole
            for i in np.flatnonzero(done):
                out[left[i]] = ids[i, : take[i]]
            left, width = left[~done], width * 4
        return out

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that hold each row of ``x``."""
        ids, d = self.search(x, 16)
        out = []
        for own, dist in zip(ids, d, strict=True):
            chosen = [own[0]]
            for c, dc in zip(own[1:], dist[1:], strict=True):
                if dc > CLOSURE * dist[0] or len(chosen) == COPIES:
                    break
                if (((self.centroids[chosen] - self.centroids[c]) ** 2).sum(1) >= dc * dc).all():
                    chosen.append(c)
            out.append(np.array(chosen))
        return out


def calibrate(graph: Graph, sample: np.ndarray, top: int, queries: int = 256) -> float:
    """How many times as far as the nearest centroid the lists of ``AIM`` of all neighbours are."""
    q, rest = sample[:queries], sample[queries:]
    if len(graph.centroids) < 2 or len(rest) < top:
        return np.inf
    nearest = np.argpartition(_squared(q, rest), top - 1, axis=1)[:, :top]
    held = {i: c for i, c in zip(np.unique(nearest), graph.lists_of(rest[np.unique(nearest)]), strict=True)}
    d = np.sqrt(_squared(q, graph.centroids))
    base = d.min(axis=1)
    needed = [d[i, held[j]].min() / max(base[i], 1e-12) for i in range(len(q)) for j in nearest[i]]
    return float(np.quantile(needed, AIM))


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dims)


def build(vectors: DataFrame, list_size: int = LIST_SIZE) -> tuple[DataFrame, Graph | None, DataFrame]:
    """(usable vectors as (vec_id, v), the centroids' graph, the index as (list, vec_id, v)).

    Vectors take no part if missing, all zero, with missing or non-finite parts, or of another
    length than most.  The graph is None if none is left.
    """
    rows = vectors.where(_usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not lengths:
        return rows, None, rows.withColumn("list", F.lit(0)).select("list", "vec_id", "v")
    dims, n = lengths[0]["dims"], lengths[0]["count"]
    rows = rows.where(F.size("v") == dims)
    part = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000)) < int(min(1.0, 0.9 * SAMPLE / n) * 1_000_000) + 1
    sample = _matrix(rows.where(part).limit(SAMPLE).select("v").toArrow()["v"], dims)
    sample = sample[np.random.default_rng(SEED).permutation(len(sample))]
    graph = Graph(balanced_centroids(sample if len(sample) else np.ones((1, dims)), int(np.clip(n // list_size, 1, MAX_CENTROIDS))))
    held = vectors.sparkSession.sparkContext.broadcast(graph)
    graph.sample = sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                p = b.slice(s, 2000)
                lists = held.value.lists_of(_matrix(p["v"], dims))
                times = pa.array(np.repeat(np.arange(p.num_rows), [len(c) for c in lists]))
                yield pa.record_batch([pa.array(np.concatenate(lists).astype(np.int32)), p["vec_id"].take(times), p["v"].take(times)], ["list", "vec_id", "v"])

    return rows, graph, cut_lineage(rows.mapInArrow(assign, "list int, vec_id long, v array<double>"))


def search(queries: DataFrame, graph: Graph | None, index: DataFrame, top: int = 10, block: int = BLOCK) -> DataFrame:
    """The ``top`` nearest rows of ``index`` for each row of ``queries`` (vec_id, v), other than rows with
    its own vec_id: query_id, rank, vec_id, score."""
    schema = "query_id long, vec_id long, score double"
    if graph is None:
        empty = queries.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        return empty.where("false")
    dims = graph.centroids.shape[1]
    sizes = np.zeros(len(graph.centroids), np.int64)
    for r in index.groupBy("list").count().collect():  # at most MAX_CENTROIDS rows
        sizes[r["list"]] = r["count"]
    ratio = calibrate(graph, graph.sample, top)
    plain = Graph.__new__(Graph)
    plain.__dict__ = {k: v for k, v in graph.__dict__.items() if k != "sample"}
    held = queries.sparkSession.sparkContext.broadcast((plain, sizes))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, full = held.value
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                p = b.slice(s, 2000)
                lists = near.within(_matrix(p["v"], dims), ratio, full, COPIES * (top + 1))
                times = pa.array(np.repeat(np.arange(p.num_rows), [len(c) for c in lists]))
                yield pa.record_batch([pa.array(np.concatenate(lists).astype(np.int32)), p["vec_id"].take(times), p["v"].take(times)], ["list", "vec_id", "v"])

    asked = cut_lineage(queries.select("vec_id", "v").mapInArrow(choose, "list int, vec_id long, v array<double>"))
    counts = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_s"))
    counts = cut_lineage(counts.join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_t")), "list"))
    counts = F.broadcast(counts)  # a row per centroid
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(counts, "list").select("list", mine("_s").alias("s"), every("_t").alias("t"), "vec_id", "v")
    right = asked.join(counts, "list").select("list", every("_s").alias("s"), mine("_t").alias("t"), "vec_id", "v")

    def meet(rows: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(rows) and len(asking):
            ids, x = np.asarray(rows["vec_id"], np.int64), _matrix(rows["v"], dims)
            q_ids, q = np.asarray(asking["vec_id"], np.int64), _matrix(asking["v"], dims)
            for s in range(0, len(q), 256):
                rough = _squared(q[s : s + 256], x)
                rough[q_ids[s : s + 256, None] == ids[None, :]] = np.inf
                k = min(top, len(x)) - 1
                # All that rounding might put among the nearest; the exact distance decides.
                limit = np.partition(rough, k, axis=1)[:, k] * (1 + 1e-9) + 1e-9 * (q[s : s + 256] ** 2).sum(1)
                for i, (row, most) in enumerate(zip(rough, limit, strict=True), s):
                    near = np.flatnonzero((row <= most) & (row < np.inf))
                    exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    best = np.lexsort((ids[near], exact))[:top]
                    out.append((np.full(len(best), q_ids[i]), ids[near][best], exact[best]))
        found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(found, ["query_id", "vec_id", "score"])

    by = ["list", "s", "t"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # found in several lists
    return once.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, is_query: Column, top: int = 10, list_size: int = LIST_SIZE, block: int = BLOCK) -> DataFrame:
    """For the rows of ``vectors`` (vec_id, embedding) where ``is_query`` holds their ``top`` nearest
    other rows: query_id, rank, vec_id, score (Euclidean distance), ties to the smaller vec_id; all
    rows if there are fewer.  Rows without vec_id take no part, other columns are not looked at.  Rows
    with the same vec_id as the query are its own; other rows that share a vec_id come once, with the
    smallest distance."""
    rows, graph, index = build(vectors.where(F.col("vec_id").isNotNull()), list_size)
    return search(rows.where(is_query), graph, index, top, block)
