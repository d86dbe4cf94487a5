"""Patience alignment and license scans against plain versions."""

import random
import re

from tablemend.llm import licenses as L


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_increasing():
    rng = random.Random(1)
    for _ in range(200):
        v = rng.sample(range(40), 12)
        best = [1] * 12
        for i in range(12):
            best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
        got = [v[i] for i in L._longest_increasing(v)]
        assert got == sorted(got) and len(got) == max(best)


def test_alignments_are_common_subsequences():
    rng = random.Random(2)
    for n in (3, 8, 30):
        for _ in range(200):
            a, b = ([rng.randrange(n) for _ in range(rng.randrange(0, 20))] for _ in range(2))
            pairs = L.align(a, b)
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
            assert len(L._common(a, b)) == lcs(a, b) >= len(pairs)
    words = list(range(60))
    for _ in range(100):  # a template with words dropped, put in and repeated is found whole
        text = [w for w in words if rng.random() > 0.1]
        for _ in range(5):
            text.insert(rng.randrange(len(text)), rng.choice([99, 98, 97]))
        assert len(L.align(text, words)) == lcs(text, words)


def test_scan(spark, sf):
    filler = "the quick brown fox is of this and that "
    mit = L.TEMPLATES["MIT"]
    rows = [
        (1, "x " * 500 + mit + " y" * 500),
        (2, mit.replace("free of charge", "gratis").upper()),
        (3, filler * 3000 + "Released under the MIT License. " + filler * 10 + "Released, under -- the MIT license!"),
        (4, filler * 50),
        (5, None),
        (6, ""),
        (7, "license MIT the under released"),
        (8, mit[: len(mit) // 2]),
        (9, "Licensed under CC BY-NC 4.0."),
        (9, "Licensed under CC BY-NC 4.0."),
        (None, "Licensed under the Apache License, Version 2.0."),
    ]
    df = spark.createDataFrame([(d, t, "MIT", 0) for d, t in rows], "doc_id long, text string, license string, start int")
    got = sorted(((r.doc_id, r.license, r.start, r.end, round(r.coverage, 2)) for r in L.scan(df).collect()), key=str)
    words = len(mit.split())
    assert [g for g in got if g[0] == 1] == [(1, "MIT", 500, 500 + words, 1.0)]
    assert [(g[1], g[4] > 0.95) for g in got if g[0] == 2] == [("MIT", True)]
    assert [(g[1], g[4], g[3] - g[2]) for g in got if g[0] == 3] == [("MIT notice", 1.0, 5), ("MIT notice", 1.0, 6)]
    assert [g[1] for g in got if g[0] == 9] == ["CC-BY-NC-4.0 notice"] * 2 and [g[1] for g in got if g[0] is None] == ["Apache-2.0 notice"]
    assert not [g for g in got if g[0] in (4, 5, 6, 7, 8)]
    assert L.scan(df.limit(0)).collect() == []


def test_lines_of_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = {"MIT notice": "Released under the MIT License.", "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.", "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0."}
    want = {(r.doc_id, k) for r in docs.collect() for k, v in lines.items() if re.search(re.escape(v), r.text, re.I)}
    got = {(r.doc_id, r.license) for r in L.scan(docs).where("coverage = 1").collect()}
    assert want and want <= got


def test_sibling_licenses_are_not_reported(spark):
    gpl = L.TEMPLATES["GPL-3.0"]
    texts = {
        "Released under the BSD License.": [],
        "Licensed under CC BY 4.0.": [],
        "Licensed under CC BY-SA 4.0.": [],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        gpl.replace("version 3", "version 2"): [],
        gpl.replace("GNU General", "GNU Lesser General"): [],
        gpl.replace("GNU General", "GNU Affero General"): [],
        "This work is licensed under the GNU General Public License, version 2.": [],
        gpl: ["GPL-3.0"],
        L.TEMPLATES["Apache-2.0"]: ["Apache-2.0"],
        "Licensed under the Apache License, Version 2.0. Released under the MIT License.": ["Apache-2.0 notice", "MIT notice"],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(r.doc_id, r.license) for r in L.scan(df).collect()]
    assert sorted(got) == [(i, k) for i, ks in enumerate(texts.values()) for k in ks]
