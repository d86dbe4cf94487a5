"""The n-gram join against all pairs."""

import random

from tablemend.llm.components import components
from tablemend.llm.ngram_join import join_similar

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(docs, percent):
    sets = []
    for _, t in docs:
        w = (t or "").translate(str.maketrans(UP + "\t\n\v\f\r", LOW + "     ")).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def near_copies(rng, vocab, base, n, most):
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(0, most)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        yield " ".join(w)


def test_against_all_pairs(spark):
    for seed, percent, size in ((1, 90, 120), (2, 90, 12), (3, 80, 60)):
        rng = random.Random(seed)
        vocab = [f"w{i}" for i in range(60)]
        texts = []
        for _ in range(6):
            base = " ".join(rng.choice(vocab) for _ in range(size))
            texts += near_copies(rng, vocab, base, 25, 7)
        line = "the same opening line of them all "
        texts += [line + " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30))) for _ in range(30)]
        texts += ["", None, " \n", "One", "one", "one two", "ONE\tTWO", "two one", "É one", "é one", line * 400, line * 401, texts[0], texts[0].upper()]
        rng.shuffle(texts)
        docs = [(i * 3, t) for i, t in enumerate(texts)] + [(9, texts[3]), (9, texts[4]), (9, texts[3]), (None, texts[5]), (None, "alone here now")]
        df = spark.createDataFrame([(d, t, 1, "c", "l") for d, t in docs], "doc_id long, text string, n int, class string, label string")
        got = sorted((tuple(r) for r in join_similar(df, percent).collect()), key=str)
        assert got == brute(docs, percent)


def test_empty_table(spark):
    assert join_similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(50, 50), (200, 190)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 1 for k in range(1, 40)) and got[200] == got[190] == 190
