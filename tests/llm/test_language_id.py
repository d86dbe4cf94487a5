"""Language ID: exact filters, held-out accuracy, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablemend.llm import language_id as L


def test_grams_are_those_of_each_word():
    words = pa.array([b"ab", b"c", "é".encode()], pa.large_binary())
    codes, of_word = L._grams(words)
    got = {(bytes([c >> 24, c >> 16 & 255, c >> 8 & 255, c & 255]).rstrip(b"\0"), w) for c, w in zip(codes.tolist(), of_word.tolist(), strict=True)}
    assert got == {(b" ab", 0), (b"ab ", 0), (b" ab ", 0), (b" c ", 1), (b" \xc3\xa9", 2), (b"\xc3\xa9 ", 2), (b" \xc3\xa9 ", 2)}


def test_filters_have_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 2**32, 20_000))
    masks = rng.random((len(grams), 11)) < 0.3
    f = L.Filters([f"l{i:02}" for i in range(11)], grams, masks)
    found = f.containing(grams).astype(bool)
    assert (found >= masks).all()
    others = np.setdiff1d(rng.integers(0, 2**32, 50_000), grams)
    assert np.allclose(f.containing(others).mean(axis=0), f.false_hits, atol=0.01)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = L.identify(docs, L.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and 100 < len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog", "en", 1.0) for i in range(20)] + [(i, "der hund und die katze", "de", 1.0) for i in range(20, 40)]
    rows += [(40, None, "en", 1.0), (41, "", "de", 1.0), (42, "123 ###", "en", 1.0), (43, "the dog " * 30_000, None, 1.0), (None, "die katze", None, 1.0), (44, "ЖЖЖ", None, 1.0), (44, "ЖЖЖ", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = L.identify(df, L.learn(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[40] == by[41] == by[42] == ("und", 0.0)
    assert by[43][0] == "en" and by[None][0] == "de" and by[44] == ("de", 0.0)


@pytest.mark.parametrize("rows", [[], [(1, "some text", None)]])
def test_nothing_learned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(df, L.learn(df)).collect()] == ["und"] * len(rows)
