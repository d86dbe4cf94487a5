"""The pipeline's stages against brute-force decisions on each stage's own input."""

import re

import corpus_pipeline as P
from tablemend.llm import bpe, language_id
from test_ngram_join import brute as join_brute


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before, docs)
        if k < 4:
            assert docs.columns == columns
    before, after = seen["language ID"]
    found = language_id.identify(before, language_id.learn(before)).collect()
    assert ids(after) == sorted(r.doc_id for r in found if r.lang_pred != "und" and r.hit_share >= P.MIN_HIT_SHARE)
    before, after = seen["exact dedup"]
    first = {}
    for d, t in sorted((r.doc_id, r.text) for r in before.collect()):
        first.setdefault(re.sub(rb"[\x20\x09-\x0D]+", b" ", t.encode()), d)
    assert ids(after) == sorted(first.values())
    before, after = seen["n-gram Jaccard join"]
    assert ids(after) == sorted(d for d, _, c in join_brute([(r.doc_id, r.text) for r in before.collect()], 90) if c == d)
    before, after = seen["byte-level BPE"]
    by = bpe.encoding(*bpe.vocabulary(spark))
    texts = {r.doc_id: r.text for r in before.collect()}
    assert ids(after) == ids(before)
    for r in after.collect():
        assert r.n_tokens * 4 == len(r.ids) and r.n_tokens == len(by.encode_ordinary(texts[r.doc_id]))


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s1", 0), (2, "the the the", None, None, 1), (2, "the the the", None, None, 1), (3, "the cat " * 9000, "en", "src1", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        rows = start
        for k, (_, stage) in enumerate(P.STAGES):
            path = str(tmp_path / f"{id(start)}-{k}")
            stage(spark, rows, "").write.parquet(path)
            rows = spark.read.parquet(path)
        assert set(ids(rows)) <= {2, 3}


def test_rows_are_judged_one_by_one(spark):
    text, other = ("the cat sat on the %s mat and looked at the dog " % k * 40 for k in ("red", "blue"))
    near = text + "again"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, other), (None, other), (None, "12 34"), (5, near), (5, near), (4, near)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda stage, df: sorted(((r.doc_id, r.text) for r in stage(spark, df, "").collect()), key=str)
    assert left(P.language, docs) == sorted((r for r in rows if r[1] != "12 34"), key=str)
    assert left(P.exact, docs) == sorted([(1, text), (None, other), (None, "12 34"), (4, near)], key=str)
    assert left(P.near, docs.where("text like '%red%'")) == [(1, text)]
    backwards = spark.createDataFrame([(d, near, "en", "s", 1) for d in (9, 3, 3, None)], docs.schema).coalesce(1)
    assert left(P.near, backwards) == [(3, near)]
