"""Byte-level BPE against the library on whole texts, and round trips."""

import random

import numpy as np
import pytest

from tablemend.llm import bpe


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.vocabulary(spark)


def test_segments_change_nothing(vocabulary):
    by = bpe.encoding(*vocabulary)
    rng = random.Random(3)
    bits = ["a", "é", "'s", "'", "7", "42", " ", "  ", "\n", "\t \n", "!", "…", "don't", "x1y2", "　", "語", "\x1c", " ", "\x85"]
    for n in (1, 50, 2000):
        for _ in range(60):
            text = "".join(rng.choice(bits) for _ in range(n))
            assert bpe.token_ids(text, by, segment=7).tolist() == by.encode_ordinary(text)
            assert bpe.token_ids(text, by).tolist() == by.encode_ordinary(text)


def test_long_runs(vocabulary):
    by = bpe.encoding(*vocabulary)
    for run in (" " * 5000, "\n" * 5000, " \t" * 3000):
        for text in (run, run + "x", "x" + run, "x" + run + "y 1" + run):
            assert bpe.token_ids(text, by).tolist() == by.encode_ordinary(text)
    for text in (" " * 3_000_000 + "x", "word " * 50_000 + "\n" * 2_000_000, "a1" * 400_000, "é" * 200_000):
        assert by.decode(bpe.token_ids(text, by).tolist()) == text


def test_table(spark, vocabulary):
    by = bpe.encoding(*vocabulary)
    rows = [(1, "Hello  wörld's 12", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "a\n" * 50_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(df, *vocabulary), *vocabulary).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == sorted(
        (str(d), len(by.encode_ordinary(t or "")), by.encode_ordinary(t or ""), (t or "").encode()) for d, t, _ in rows
    )
    assert sorted(map(str, bpe.there_and_back(df, *vocabulary).collect())) == sorted(map(str, got))
    assert bpe.encode(df.limit(0), *vocabulary).collect() == []


def test_ids_may_be_cut_within_a_character(spark, vocabulary):
    by = bpe.encoding(*vocabulary)
    ids = by.encode_ordinary("語彙")
    cut = [i for i in range(len(ids)) if b"".join(by.decode_tokens_bytes(ids[:i])).decode("utf-8", "ignore").encode() != b"".join(by.decode_tokens_bytes(ids[:i]))]
    rows = [(k, len(ids[:k]), np.array(ids[:k], "<u4").tobytes()) for k in cut or [1]]
    for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary"), *vocabulary).collect():
        assert bytes(r.decoded) == b"".join(by.decode_tokens_bytes(ids[: r.doc_id]))
