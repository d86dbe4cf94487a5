"""The id coder's round trips and checksums; files against whole-text encoding."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablemend.llm import idcoder, token_files


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def test_round_trips():
    rng = np.random.default_rng(1)
    streams = [[], [0], [65535] * 3, [7] * 70_000, rng.integers(0, 49408, 30_000), rng.zipf(1.3, 60_000) % 50_000, np.tile(rng.integers(0, 300, 500), 200), np.arange(5000), [2**20, 1, 2**20]]
    for ids in streams:
        ids = np.array(ids, np.uint32)
        coded = idcoder.encode(ids)
        assert (idcoder.decode(coded) == ids).all()
    assert len(idcoder.encode(np.tile(rng.integers(0, 300, 100), 1000))) < 60_000


def test_damage_is_an_error():
    coded = bytearray(idcoder.encode(np.random.default_rng(2).integers(0, 1000, 5000)))
    for at in (0, 20, 250, len(coded) - 40):
        hurt = bytearray(coded)
        hurt[at] ^= 0x55
        with pytest.raises(ValueError):
            idcoder.decode(bytes(hurt))
    with pytest.raises(ValueError):
        idcoder.decode(bytes(coded[:-2]))


def test_what_one_lane_learns_serves_all():
    """A chain of ids whose followers are learned once, not once per lane."""
    rng = np.random.default_rng(3)
    follower, jump = rng.integers(0, 20_000, 20_000), rng.random(200_000) < 0.25
    ids, other = np.zeros(200_000, np.uint32), rng.zipf(1.2, 200_000) % 20_000
    for k in range(1, len(ids)):
        ids[k] = other[k] if jump[k] else follower[ids[k - 1]]
    coded = idcoder.encode(ids)
    assert (idcoder.decode(coded) == ids).all()
    assert len(coded) < 200_000


def test_blocks_are_read_alone(monkeypatch):
    rng = np.random.default_rng(4)
    ids = (rng.zipf(1.2, 50_000) % 50_000).astype(np.uint32)
    monkeypatch.setattr(idcoder, "BLOCK_TOKENS", 20_000)
    coded = idcoder.encode(ids)
    first, end = idcoder._read(coded, 8)
    hurt = coded[:8] + bytes(end - 8) + coded[end:]
    second, end = idcoder._read(hurt, end)
    assert (np.concatenate([first, second]) == ids).all() and end == len(coded)
    with pytest.raises(ValueError):
        idcoder.decode(hurt)


def test_a_word_is_encoded_once(model, monkeypatch):
    """More words than were held before: the second time none is encoded."""
    by = token_files._Words(model)
    texts = pa.array([" ".join(f"w{k:x}é" for k in range(s, s + 50_000)) for s in range(0, 250_000, 50_000)])
    first, counts = by.ids(texts)
    monkeypatch.setattr(by, "_add", None)
    again, counts_again = by.ids(texts)
    assert (first == again).all() and (counts == counts_again).all()


def test_forgotten_words_are_encoded_again(model, monkeypatch):
    monkeypatch.setattr(token_files, "_HELD_WORDS", 40)
    by, whole = token_files._Words(model), Tokenizer.from_str(model)
    for k in (0, 30, 60, 0, 90, 45):
        text = " ".join(f"word{n}é, {n}" for n in range(k, k + 35))
        ids, counts = by.ids(pa.array([text, None]))
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids), 0]


def _odd_texts():
    parts = ["'s", "'T", "don't", "it's.", "!!'s", "a!'s", "'!s", "(foo,", "foo.bar", "12,345.6", "x1y2", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b.", "<|", "|>", "\u212a", "\u0130", "e\u0301", "=\u0338",
             "A\u030a", ".\u0301", "é", "Σ", "中文字", "ไทย", "½", "٣", "\u3000", "\u00a0", "\u2028", "\x85", "\x1c", "\x01", "\x00", "_", "#%$", "🙂", "\ufffd", "ab", "Z", "7", "-", "…", "ﬁ", "H\u0331", "\u0345"]
    rng = random.Random(5)
    return ["".join(rng.choice([*parts, " ", "\n", " "]) for _ in range(rng.randint(0, 40))) for _ in range(4000)]


def test_ids_are_those_of_whole_texts(model):
    by, whole = token_files._Words(model), Tokenizer.from_str(model)
    assert by.kinds.any()
    texts = _odd_texts()
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, counts = by.ids(pa.array(texts))
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == want


def test_other_tokenizers_are_not_cut(model):
    """Nothing is taken for granted about a tokenizer with another pattern."""
    parsed = json.loads(model)
    parsed["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    parsed["normalizer"] = None
    other = json.dumps(parsed)
    by, whole = token_files._Words(other), Tokenizer.from_str(other)
    assert not by.kinds.any()
    texts = [" ".join(t.split()) for t in _odd_texts()[:500]]
    ids, _ = by.ids(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids]


def test_files(spark, sf, model, tmp_path):
    by = Tokenizer.from_str(model)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(None, "no id"), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "Don't<|endoftext|>é ́x y　z ΑΣ'S it's 12a"), (1003, "Don't<|endoftext|>é ́x y　z ΑΣ'S it's 12a"), (1004, "long words " * 30_000), (1005, "İ ǅ #")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("doc_id", "text", "1 as part", "2 as chunk")
    token_files.write_ids(docs, model, str(tmp_path / "ids"), chunk_tokens=20_000)
    got = sorted(token_files.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (d, t) in zip(got, want, strict=True):
        ids = np.array([*by.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (d, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)


def test_empty_table(spark, model, tmp_path):
    token_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), model, str(tmp_path / "ids"))
    assert token_files.read_ids(spark, str(tmp_path / "ids")).collect() == []
