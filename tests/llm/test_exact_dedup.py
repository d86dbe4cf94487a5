"""Exact dedup against a brute-force version."""

import hashlib
import random
import re

from tablemend.llm.exact_dedup import group_equal


def brute(docs):
    groups = {}
    for i, (d, t) in enumerate(docs):
        groups.setdefault(re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode()), []).append((d is None, d or 0, i))
    out = []
    for body, members in groups.items():
        first = min(members)
        for m in sorted(members):
            d = None if m[0] else m[1]
            keep = None if first[0] else first[1]
            out.append((d, keep, len(members), m == first, hashlib.sha256(body).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    long = "lorem " * 2000
    docs = [(i, rng.choice(["a b", "a  b", "a\tb ", "a b\x0b", "", None, " ", long, long + "x", long + "y", "x" * 31, "x" * 32, "x" * 33, "x" * 32 + "y"])) for i in range(120)]
    docs += [(7, long), (7, long), (500, "é "), (501, "é "), (None, "a b"), (None, "only here"), (None, long)]
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in docs], "doc_id long, text string, _n int, _body string")
    for first, growth in ((32, 8), (1, 2)):
        got = sorted((tuple(r) for r in group_equal(df, first, growth).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
        assert got == brute(docs)


def test_empty_table(spark):
    assert group_equal(spark.createDataFrame([], "doc_id long, text string")).collect() == []
