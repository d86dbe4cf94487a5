"""Substring dedup against a brute-force version."""

import hashlib
import random
import re

from tablemend.llm.substring_dedup import remove_repeats
from tablemend.llm.words import BASES, PRIME, rolling


def brute(docs, size):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in docs]
    seen = {}
    for w in words:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def test_rolling_is_the_polynomial():
    import numpy as np

    rng = random.Random(1)
    v = [rng.randrange(PRIME) for _ in range(200)]
    for size in (1, 2, 3, 5, 35, 64, 200):
        got = rolling(np.array(v, np.uint64), size, BASES[0])
        want = [sum(x * pow(BASES[0], size - 1 - k, PRIME) for k, x in enumerate(v[i : i + size])) % PRIME for i in range(len(v) - size + 1)]
        assert got.tolist() == want


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}é" for i in range(40)]
    shared = " ".join(rng.choice(vocab) for _ in range(50))
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 90)))) for i in range(40)]
    docs += [(100, "a " + shared + " b"), (101, shared), (102, shared + " x\n" + shared), (103, None), (104, ""), (105, " \t\r\n "), (106, "x " * 70), (107, "one"), (108, "y " * 35)]
    docs += [(109, docs[5][1] + " z " * 50), (109, docs[5][1] + " z " * 50), (None, shared)]
    for size in (35, 3):
        df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, block_id int, bucket string")
        got = sorted(map(tuple, remove_repeats(df, size).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()), key=str)
        assert got == brute(docs, size)
        for r in remove_repeats(df, size).collect():
            assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
