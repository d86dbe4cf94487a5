"""Cross-tokenizer alignment against a plain count over all documents."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tablemend.llm import alignment, queries


@pytest.fixture(scope="module")
def models():
    return alignment.public_models()


def brute(rows, models):
    """Per row: n_a, n_b, n_groups, n_links, n_best, count_sum, groups; and the pairs' (documents, links)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(models[0]), sentencepiece.SentencePieceProcessor(model_proto=models[1])
    a.encode_special_tokens = True
    byte_of = _byte_level_alphabet()
    names = {i: t for t, i in a.get_vocab().items()}
    linked, found = [], []
    docs_of, links_of = Counter(), Counter()
    for _, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        by_a = [bytes(byte_of[c] for c in names[i]) for i in ids_a]
        by_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        want = (" " + text).encode() if text else b""
        if b"".join(by_a) != want or b"".join(by_b) != want:
            ids_a, ids_b, by_a, by_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in by_a]).tolist(), np.cumsum([len(x) for x in by_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for end in common:
            ga, gb = [], []
            while i < len(ends_a) and ends_a[i] <= end:
                ga.append(ids_a[i])
                i += 1
            while j < len(ends_b) and ends_b[j] <= end:
                gb.append(ids_b[j])
                j += 1
            groups.append((ga, gb))
        own = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        docs_of.update(own.keys())
        links_of.update(own)
        linked.append(own)
        found.append([len(ids_a), len(ids_b), len(groups), sum(own.values()), ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)])
    most = defaultdict(int)
    for (x, _), n in docs_of.items():
        most[x] = max(most[x], n)
    out = []
    for own, (n_a, n_b, n_groups, n_links, groups) in zip(linked, found, strict=True):
        best = sum(m for p, m in own.items() if docs_of[p] == most[p[0]])
        out.append((n_a, n_b, n_groups, n_links, best, sum(m * docs_of[p] for p, m in own.items()), groups))
    return out, docs_of, links_of


def _byte_level_alphabet():
    from tokenizers.pre_tokenizers import ByteLevel

    """How the library shows each byte that a text can hold."""
    own = {}
    for c in range(256):
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]
        for raw, ch in zip(chr(c).encode(), shown, strict=True):
            own[ch] = raw
    for lead in range(0xC4, 0xF5):
        second = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
        text = bytes([lead, second] + [0x80] * (0 if lead < 0xE0 else 1 if lead < 0xF0 else 2))
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text.decode())[0][0]
        for raw, ch in zip(text, shown, strict=True):
            own[ch] = raw
    return own


ODD = [
    None, "", " ", "  ", "a", "Hello  world", "tab\tand\nline", "naïve café 語彙 🙂🙂", "x" * 300, "<s> </s> <unk> <|endoftext|> <0x41>", "▁", "a▁b",
    " leading and trailing ", " nbsp", "é", "ﬁ ligature", "\x1c\x1d", "1234567 12.5", "it's don't", "Ω≈ç√∫˜µ≤", "same text", "same text",
]


def check(got, rows, models):
    want, _, _ = brute(rows, models)
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == sorted((str(d), *w) for (d, _), w in zip(rows, want, strict=True))


def test_rows(spark, models):
    rng = random.Random(4)
    bits = ["the", "theory", "é", "語", "🙂", "unaligned", "12", "…", "don't", "xyzzyx"]
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (7, "an id twice")]
    rows += [(100 + k, " ".join(rng.choice(bits) for _ in range(rng.randrange(400)))) for k in range(60)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, groups string").repartition(3)
    blocks = alignment.posting_blocks(df, models, block_bytes=2000)
    check(alignment.scored(blocks).collect(), rows, models)
    _, docs_of, links_of = brute(rows, models)
    pairs = alignment.pair_counts(spark.createDataFrame(blocks.collect(), blocks.schema)).collect()
    assert {(r.a_id, r.b_id): (r.n_docs, r.n_links) for r in pairs} == {p: (n, links_of[p]) for p, n in docs_of.items()}
    assert blocks.count() > 3


def test_string_ids_and_empty_table(spark, models):
    check(alignment.align(spark.createDataFrame([("x", "one two")], "doc_id string, text string"), models).collect(), [("x", "one two")], models)
    assert alignment.align(spark.createDataFrame([], "doc_id string, text string"), models).collect() == []


def test_stretches_change_nothing(models):
    by = alignment.tokenizers(models)
    rng = random.Random(9)
    bits = ["the", "é", "語", "🙂", "12", "don't", "a  b", "\n", "\tx", ".", "'s", "\x1c", "▁", " ", "\u3000", "\xa0y"]
    for _ in range(500):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 60)))
        whole, parts = alignment._Aligned(by, [text]), alignment.stretches(text)
        assert " ".join(parts) == text
        cut = alignment._Aligned(by, parts)
        assert cut.fits.all() == whole.fits.all()
        if whole.fits.all():
            assert b";".join(cut.written(by)) == b";".join(whole.written(by))


def test_white_space_at_the_end_of_a_text_touches_no_other(spark, models):
    rows = list(enumerate(["one ", "語", "two  ", "語 x", "three\t", " 語", "four", "\n語", "five \n", "six seven"]))
    by = alignment.tokenizers(models)
    texts = [t for _, t in rows]
    side_by_side = alignment._Aligned(by, texts)
    assert side_by_side.written(by) == [alignment._Aligned(by, [t]).written(by)[0] for t in texts]
    check(alignment.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), models).collect(), rows, models)


def test_slices_and_large_groups(spark, models, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 50)
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 3)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "🙂", "语x", "tion", "a\tb"]) for _ in range(60)) for _ in range(9)] + ["good words then  two spaces " + "▁ x" * 40, "🙂语" * 50]
    by, block = alignment.tokenizers(models), alignment._Block()
    block.take(list(range(4)), texts[:4])
    block.take(list(range(4, 11)), texts[4:])
    row = block.row(by, 0, pa.int64())
    blocks = spark.createDataFrame(row.to_pylist(), alignment.posting_blocks(spark.createDataFrame([(1, "")], "doc_id long, text string"), models).schema)
    check(alignment.scored(blocks).collect(), list(enumerate(texts)), models)


def test_bitmaps():
    rng = np.random.default_rng(1)
    for docs in (1, 7, 8, 100, 3000):
        held = rng.random((20, docs)) < rng.random(20)[:, None] ** 3
        held[3] = True
        index, places = np.nonzero(held)
        plane = alignment.packed(index, places, docs)
        at, counts = alignment.popcounts(plane, docs)
        assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == {k: int(n) for k, n in enumerate(held.sum(1)) if n}
        back = np.zeros_like(held)
        back[alignment.unpacked(plane, docs)] = True
        assert (back == held).all()


def test_query(spark, sf, models):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, _, _ = brute(rows, models)
    got = {r.doc_id: r for r in queries.op12_alignment(spark, sf).collect()}
    assert len(got) == len(rows)
    for (d, _), (*numbers, groups) in zip(rows, want, strict=True):
        r = got[d]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
