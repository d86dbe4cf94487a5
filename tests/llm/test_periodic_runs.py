"""Periodic runs against a search over every period, in slabs of every size."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tablemend.llm import periodic_runs, queries
from tablemend.llm.periodic_runs import find_runs, runs_of


def brute(words, exponent=4, least=6):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                best.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(5)
    for n in list(range(0, 40)) + [64, 100, 257, 500]:
        for letters in (1, 2, 3, 20):
            words = [rng.randrange(letters) for _ in range(n)]
            yield words
            if n > 12:  # a periodic stretch within
                p, a = rng.randint(1, max(1, n // 5)), rng.randrange(n // 2)
                yield words[:a] + [words[a + (i - a) % p] for i in range(a, n - 3)] + words[n - 3 :]
    nested = ([0] * 6 + [1]) * 9
    yield nested
    yield ([2, 3] * 5 + nested) * 4
    fib = [0], [0, 1]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]
    yield [bin(i).count("1") % 2 for i in range(512)]  # defeats hashes that are sums of powers


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (2, 6), (3, 1)])
def test_every_run(exponent, least):
    for words in texts():
        want = brute(words, exponent, least)
        assert [tuple(r) for r in runs_of(np.array(words, np.int64), exponent, least).tolist()] == want
        for slab in (1, 3, 64) if len(words) < 120 else (50,):
            assert [tuple(r) for r in runs_of(np.array(words, np.int64), exponent, least, slab).tolist()] == want


def test_late_levels_of_a_long_text(monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLAB", 16)
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1000, 3000)
    words[500:2900] = words[500:1100][np.arange(2400) % 600]
    for slab in (7, 400):
        assert runs_of(words, 4, 6, slab).tolist() == [[500, 2400, 600]]


def test_long_periodic_text_takes_linear_time():
    for p in (1, 7, 5000):
        words = np.arange(300_000) % p
        assert runs_of(words).tolist() == [[0, 300_000, p]]


def test_codes_that_meet_by_chance(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_coded", lambda left, right: (left + right) % np.uint64(2))
    for words in list(texts())[:200]:
        got = {tuple(r) for r in runs_of(np.array(words, np.int64)).tolist()}
        assert got == set(brute(words))


def test_table(spark):
    rows = [(1, "a b a b a b a b c", 1), (2, None, 1), (3, "", 1), (3, "", 1), (None, " \t x　x x x x x x x x\n", 1), (4, "é é é é é é", 1), (5, "w " * 50_000, 1)]
    got = {(r.doc_id, r.n_words): r for r in find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()}
    assert got[1, 9].collapsed == "a b c" and [tuple(x) for x in got[1, 9].runs] == [(0, 8, 2)]
    assert got[2, 0].collapsed == got[3, 0].collapsed == "" and got[2, 0].runs == []
    assert got[None, 8].collapsed == "x　x x" and [tuple(x) for x in got[None, 8].runs] == [(1, 7, 1)]
    assert got[4, 6].collapsed == "é" and got[5, 50_000].collapsed == "w"
    assert find_runs(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = re.findall(r"[^ \t-\r]+", d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if len(words) > 1500 and h % 10:  # the search over every period takes long
            continue
        runs = brute(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        r = got[d.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert planted
