"""WARC archives: what is written is read back; broken archives are told, not lost."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib

import pytest

from tablemend.llm import warc
from tablemend.session import scratch_path


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) per row, sorted."""
    groups = {}
    for i, (page, url, html) in enumerate(rows):
        body = (html or "").encode()
        groups.setdefault(body if len(body) >= least else i, []).append((page is not None, page or 0, i, url))
    out = []
    for members in groups.values():
        top = max(m[:2] for m in members)
        first = min((m for m in members if m[:2] == top), key=lambda m: (m[3] is not None, m[3] or "", m[2]))
        for m in members:
            page, _, html = rows[m[2]]
            body = (html or "").encode()
            out.append((page, len(body), digest(body), "response" if m is first else "revisit", None if m is first else rows[first[2]][0]))
    return sorted(out, key=str)


def there_and_back(spark, rows, least=0, **kw):
    path = scratch_path(spark)
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    warc.write_archives(df.repartition(3), path, least, **kw)
    return path, warc.resolved(warc.read_records(warc.written(spark, path)))


@pytest.mark.parametrize("least", [0, 5])
def test_rows(spark, least):
    rng = random.Random(1)
    bodies = [None, "", "ab", "<p>é</p>", "WARC/1.1\r\n\r\n\r\n\r\n", "x" * 300_000, "".join(map(chr, range(32, 5000)))]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "http://a/", "http://b/\r\nWARC-Type: response"]), rng.choice(bodies)) for _ in range(150)]
    rows += [(7, "u", "same row"), (7, "u", "same row"), (7, "t", "same row"), (3, "u", "same row"), (None, None, "lone")]
    rows += [(None, None, "without ids")] * 3 + [(k, "u", "hot") for k in range(100, 200)]
    path, records = there_and_back(spark, rows, least, archive_bytes=4000)
    got = records.collect()
    assert {r.problem for r in got} == {None}
    assert sorted(((None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got), key=str) == brute(rows, least)
    ids = [r.record_id for r in got]
    assert len(set(ids)) == len(ids)
    whole = sorted(bytes(r.payload) for r in got if r.record_type == "response")
    assert {digest(w) for w in whole} == {d for _, _, d, _, _ in brute(rows, least)}
    assert all(r.payload == b"" for r in got if r.record_type == "revisit")
    files = warc.written(spark, path).collect()
    assert len(files) > 3
    assert sorted(r.file.split("/")[-1] for r in warc.found(spark, path).collect()) == sorted(f.file.split("/")[-1] for f in files)
    again = warc.resolved(warc.read_records(warc.found(spark, path), with_payload=False))
    assert sorted(again.select("record_id", "payload_digest", "problem").collect()) == sorted(records.select("record_id", "payload_digest", "problem").collect())


def test_empty_table(spark):
    path, records = there_and_back(spark, [])
    assert records.collect() == []


def test_members_are_records(spark):
    path, _ = there_and_back(spark, [(k, f"http://a/{k}", f"text {k % 4}") for k in range(20)])
    members = 0
    for f in warc.written(spark, path).collect():
        with open(f.file.removeprefix("file://"), "rb") as raw:
            data = raw.read()
        plain = gzip.decompress(data)
        while data:
            by = zlib.decompressobj(31)
            one = by.decompress(data)
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and plain.startswith(one)
            plain, data, members = plain[len(one) :], by.unused_data, members + 1
    assert members == 20


class Slow(io.RawIOBase):
    """A store that gives a few bytes at a time."""

    def __init__(self, data, size):
        self.data, self.size, self.at = data, size, 0

    def read(self, n=-1):
        out = self.data[self.at : self.at + min(n, self.size)]
        self.at += len(out)
        return out


def records(payloads):
    return [warc.record("response", f"<urn:{k}>", str(k), "http://a/", p) for k, p in enumerate(payloads)]


def test_pieces_of_any_size(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    payloads = [b"", b"a", b"\r\n\r\n" * 9, bytes(range(256)) * 40, warc.MAGIC * 3]
    data = b"".join(map(warc.member, records(payloads)))
    for size in (1, 5, 1000):
        got = list(warc.read_stream(Slow(data, size), "f"))
        assert [r["payload"] for r in got] == payloads and {r["problem"] for r in got} == {None}
    assert [r["offset"] for r in got] == [sum(len(warc.member(x)) for x in records(payloads)[:k]) for k in range(5)]


def test_broken_archives():
    a, b, c = records([b"one", b"two two two", b"three"])
    m = warc.member

    def problems(data):
        for size in (3, 10_000):
            got = [(r.get("record_id"), r["problem"]) for r in warc.read_stream(Slow(data, size), "f")]
        return got

    ok = [("<urn:0>", None), ("<urn:2>", None)]

    def between(x, said, rid="<urn:1>"):
        assert problems(m(a) + x + m(c)) == [ok[0], (rid, said), ok[1]]

    between(m(b.replace(b"two two", b"two tvo")), "block digest differs")
    length = int(re.search(rb"Content-Length: (\d+)", b)[1])

    def of_length(n):
        return b.replace(b"Content-Length: %d" % length, b"Content-Length: %d" % n, 1)

    between(m(of_length(length - 1)), "block longer than Content-Length")
    between(m(of_length(length + 1)), "no end behind the block")
    between(m(of_length(length + 9)), "block shorter than Content-Length")
    between(m(b.replace(b"Page-ID", b"Content-Length: x\r\nPage-ID", 1)), "no Content-Length")
    between(m(b + c), "member holds more than a record")
    between(m(b[:-4]), "no end behind the block")
    between(m(b[:40]), "head without end", None)
    between(m(b"HTTP/1.1 200\r\n\r\n"), "not a WARC record", None)
    between(b"garbage", "bytes between members", None)
    torn = bytearray(m(b))
    torn[30] ^= 255
    got = problems(m(a) + bytes(torn) + m(c))
    assert got[0] == ok[0] and got[-1] == ok[1] and all(p for _, p in got[1:-1]) and len(got) > 2
    assert problems(m(a) + m(c)[:-20])[-1][1] == "archive ends within a member"
    assert problems(b"") == [] and problems(b"no archive") == [(None, "bytes between members")]


def test_digests_and_references(spark, tmp_path):
    a, b = warc.record("response", "<urn:a>", "1", None, b"body"), warc.record("revisit", "<urn:b>", "2", None, b"body", "<urn:a>")
    lost = warc.record("revisit", "<urn:c>", "3", None, b"body", "<urn:z>")
    other = warc.record("revisit", "<urn:d>", "4", None, b"other", "<urn:a>")
    forged = a.replace(digest(b"body").encode(), digest(b"dy").encode(), 1).replace(b"<urn:a>", b"<urn:e>")
    alien = b"WARC/1.0\r\nwarc-type:  resource \r\nWARC-Record-ID: <urn:f>\r\nWARC-Block-Digest: md5:00\r\nContent-Length: 4\r\n\r\nHTTP\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(warc.member, (b, a, lost, other, forged, alien))))
    got = {r.record_id[5]: r for r in warc.resolved(warc.read_records(warc.found(spark, str(tmp_path)))).collect()}
    assert {k: r.problem for k, r in got.items()} == {"a": None, "b": None, "c": "response not found", "d": "declared digest differs", "e": "payload digest differs", "f": None}
    assert got["b"].refers_to == "1" and got["b"].payload_bytes == 4 and got["b"].payload_digest == digest(b"body")
    assert got["f"].payload == b"HTTP" and got["f"].record_type == "resource" and got["a"].url == "about:blank"


def test_a_lost_attempt_is_not_read(spark):
    path, records = there_and_back(spark, [(1, "u", "a"), (2, "u", "b")])
    folder = path.removeprefix("file://")
    with open(f"{folder}/part-000000-0000-lost.warc.gz", "wb") as f:
        f.write(warc.member(warc.record("response", "<urn:x>", "9", None, b"half"))[:50])
    assert sorted(r.page_id for r in records.collect()) == ["1", "2"]
