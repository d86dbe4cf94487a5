"""Budgets against a water-filling loop, prefixes against a walk over each leaf's stream."""

import hashlib
import random
import re
from fractions import Fraction

from tablemend.llm import mixing

TREE = mixing.Tree([("domain", "domain"), ("lang", "lang"), ("source", "source")], {"domain": {"a": 5, "b": 3}, "lang": {"en": 4}, "source": {"s1": 2}})


def fill(given, children):
    """{name: part} for (name, weight, can), all shares exact."""
    got, open_ = {}, dict((n, (w, c)) for n, w, c in children)
    while open_:
        level = Fraction(given - sum(got.values()), sum(w for w, _ in open_.values()))
        full = [n for n, (w, c) in open_.items() if c <= level * w]
        if not full:
            rest, total, upto = given - sum(got.values()), sum(w for w, _ in open_.values()), 0
            for n in sorted(open_):
                w = open_[n][0]
                got[n] = rest * (upto + w) // total - rest * upto // total
                upto += w
            return got
        for n in full:
            got[n] = open_.pop(n)[1]
    return got


def brute(docs, share, epochs, seed):
    leaves = {}
    for d, t, *path in docs:
        n = len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
        leaves.setdefault(tuple(x or "" for x in path), []).append((d, n))
    supply = {p: sum(n for _, n in rows) for p, rows in leaves.items()}
    out, total = [], sum(supply.values())

    def down(prefix, given):
        k = len(prefix)
        if k == 3:
            left = given
            for epoch in range(1, epochs + 1):
                for _, d, n in sorted((hashlib.md5(f"{seed}|{epoch}|{d}".encode()).hexdigest(), d, n) for d, n in leaves[prefix] if n):
                    if left > 0:
                        out.append((d, *prefix, epoch, n, min(n, left)))
                        left -= n
            return
        names = sorted({p[k] for p in supply if p[:k] == prefix})
        w = TREE.weights.get(TREE.levels[k][0], {})
        can = [(n, w.get(n, TREE.other), epochs * sum(s for p, s in supply.items() if p[: k + 1] == (*prefix, n))) for n in names]
        for n, part in fill(given, can).items():
            down((*prefix, n), part)

    down((), min(int(total * share), total * epochs))
    return sorted(out, key=str)


def table(spark, docs):
    return spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id long, text string, domain string, lang string, source string, n_tokens int, _row string")


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    docs = [(i, rng.choice(["", None, " ", "w " * rng.randrange(1, 60)]), rng.choice("aaaabc"), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", "s1", None])) for i in range(300)]
    docs += [(1000, "long " * 40_000, "c", "en", "s9")]
    for share, epochs, digits in ((0.5, 2, 4), (1.7, 3, 1), (9.0, 2, 4), (0.01, 1, 4), (0.0, 1, 4)):
        monkeypatch.setattr(mixing, "BUCKET_DIGITS", digits)
        got = sorted((tuple(r) for r in mixing.mix(table(spark, docs), TREE, share, epochs, 3).collect()), key=str)
        assert got == brute(docs, share, epochs, 3), (share, epochs)


def test_rows_of_documents(spark):
    docs = [(i, "a b c " * (i % 5 + 1), "a", "en", "s1") for i in range(40)] + [(5, "x", "a", "en", "s1"), (None, "x y", None, None, None)]
    df = table(spark, docs)
    kept = mixing.mixed_documents(df, TREE, 1.5, 2, 1)
    assert kept.columns == df.columns
    want = sorted((r.doc_id is None, r.doc_id) for r in mixing.mix(df, TREE, 1.5, 2, 1).collect())
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == want


def test_empty_table(spark):
    assert mixing.mix(table(spark, []), TREE, 0.5, 2, 1).collect() == []
