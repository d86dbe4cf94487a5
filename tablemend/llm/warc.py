"""WARC archives: one gzip member per record, written and read in sequence.

Writing.  Of rows with equal payloads the one with the largest page_id is written whole, as ``response``; the
others are ``revisit`` records that name it.  Equality is that of a 256-bit digest, counted with map-side
combining; the table of repeated payloads is written and joined back, where adaptive execution splits a
payload that holds a third of all rows.  A task writes its rows to archives of a bounded size under names
of its own and reports them; the list of archives is committed by Spark.  What an attempt left behind that was
lost or came second is in no list, so nobody reads it.

Reading.  An archive is a stream: its members are decompressed piece by piece, the head of a record is
read up to its empty line, and Content-Length says where its block ends, whatever the block holds.  Digests
are computed while the bytes pass, so without payloads memory does not follow the size of a record.
Anything that does not fit is a row with a ``problem``; behind it reading goes on at the next member.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.session import cut_lineage

ARCHIVE_BYTES = 64 << 20
READ = 1 << 16  # bytes read at once
PIECE = 1 << 18  # bytes decompressed at once
LONGEST_HEAD = 1 << 20
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "file string, bytes long, records long"
_SPACE = uuid.UUID("5c9e2c1e-7f0b-5b0c-9a57-0d3b7a4f6e21")
_RECORD = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("date", pa.string()),
    ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string()), ("problem", pa.string()), ("payload", pa.binary()),
])
_RECORD_SQL = "file string, offset long, record_type string, record_id string, page_id string, url string, date string, refers_to_id string, payload_bytes long, payload_digest string, declared_digest string, problem string, payload binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _line(value: str) -> str:
    """A value that stays within its line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(kind: str, record_id: str, page_id: str | None, url: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """A response or revisit record.  A revisit has the head of the page's HTTP answer, but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url) if url is not None else 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {_line(page_id)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + END + block + END


def member(data: bytes, level: int = 6) -> bytes:
    by = zlib.compressobj(level, zlib.DEFLATED, 31)
    return by.compress(data) + by.flush()


def _opened(place: str) -> tuple[fs.FileSystem, str]:
    """The store and the path within it; Spark writes local paths as file:/..."""
    return fs.FileSystem.from_uri(place.replace("file:/", "file:///", 1) if place.startswith("file:/") and not place.startswith("file://") else place)


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, parts)))}>"


def _decided(pages: DataFrame, least: int) -> DataFrame:
    """Rows to write: page_id, url, payload, first (page_id of the payload's response) and whether the
    payload is repeated and the row itself is that response."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").alias("_page"), F.col("url").cast("string").alias("_url"), body.alias("_payload"))
    large = F.octet_length("_payload") >= least
    # A payload too small to be looked up gets a key of its own kind, dealt out by the row.
    own = F.concat(F.lit("-"), F.xxhash64("_page", "_url", "_payload").cast("string")).cast("binary")
    rows = rows.withColumn("_key", F.when(large, F.unhex(F.sha2("_payload", 256))).otherwise(own))
    counted = rows.where(large).groupBy("_key", "_page").agg(F.count(F.lit(1)).alias("_times"))
    last = F.max(F.struct(F.col("_page").isNotNull().alias("has"), F.col("_page").alias("page"), F.col("_times").alias("times")))
    groups = cut_lineage(counted.groupBy("_key").agg(F.sum("_times").alias("_size"), last.alias("_last")).where("_size > 1"))
    rows = rows.join(groups, "_key", "left")
    is_last = F.col("_size").isNotNull() & F.col("_page").eqNullSafe(F.col("_last.page"))
    tie = is_last & (F.col("_last.times") > 1)
    columns = ["_page", "_url", "_payload", F.col("_last.page").alias("_first"), F.col("_size").isNotNull().alias("_repeated")]
    out = rows.where(~tie).select(*columns, is_last.alias("_is_first"))
    if groups.where("_last.times > 1").isEmpty():
        return out
    tied = cut_lineage(rows.where(tie).withColumn("_row", F.monotonically_increasing_id()))
    order = F.struct("_url", "_row")
    first = cut_lineage(tied.groupBy("_key").agg(F.min(order).alias("_order")))
    return out.unionByName(tied.join(first.hint("merge"), "_key").select(*columns, (order["_row"] == F.col("_order._row")).alias("_is_first")))


def write_archives(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """Writes a record for every row of ``pages`` (page_id, url, html) to archives in the folder ``path``,
    which any worker must be able to open by pyarrow (a shared folder, S3, GCS or HDFS).

    A missing html is an empty payload.  Of rows with equal payloads of at least ``least`` bytes the one with the
    largest page_id is the response (a missing page_id comes last; of rows that share it, that with the
    smallest url, and of equal rows any one); smaller payloads are all written whole.  A missing url becomes
    ``about:blank``; line ends within a url are percent-encoded.  An empty table gives no archive.  Other columns
    are not looked at.  The list of archives is read by :func:`written`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _opened(path)
        store.create_dir(folder, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        out, name, size, count, files, serial = None, "", 0, 0, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["file", "bytes", "records"])

        try:
            for batch in batches:
                for r in range(batch.num_rows):
                    page, url, payload, first, repeated, is_first = (c[r].as_py() for c in batch.columns)
                    digest = base32(hashlib.sha1(payload).digest())
                    whole = is_first or not repeated
                    own = _urn("first", page, digest) if is_first else _urn(part, serial, page, digest)
                    data = member(record("response" if whole else "revisit", own, page, url, payload, None if whole else _urn("first", first, digest), date))
                    serial += 1
                    if out is None:
                        name = f"part-{part:06d}-{files:04d}-{attempt}.warc.gz"
                        out, size, count = store.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= archive_bytes:
                        yield closed()
                        out, files = None, files + 1
            if out is not None:
                yield closed()
                out = None
        finally:
            if out is not None:
                out.close()
                store.delete_file(f"{folder}/{name}")

    rows = _decided(pages, least)
    rows = rows.select(F.col("_page").cast("string"), "_url", "_payload", F.col("_first").cast("string"), "_repeated", "_is_first")
    rows.mapInArrow(run, _FILES).write.parquet(f"{path.rstrip('/')}/_files")


def written(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the archives that :func:`write_archives` committed to ``path``."""
    return spark.read.schema(_FILES).parquet(f"{path.rstrip('/')}/_files").select(F.concat(F.lit(path.rstrip("/") + "/"), "file").alias("file"), "bytes")


def found(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of all ``*.warc.gz`` in the folder ``path``, whoever wrote them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


class Broken(Exception):
    """What is wrong with a record."""


class _Source:
    """The compressed bytes of an archive, and how many are behind."""

    def __init__(self, raw):
        self.raw, self.held, self.offset = raw, b"", 0

    def next(self) -> bytes:
        data, self.held = self.held or self.raw.read(READ), b""
        self.offset += len(data)
        return bytes(data)

    def give_back(self, data: bytes) -> None:
        self.held = data + self.held
        self.offset -= len(data)

    def at_member(self) -> bool:
        """Goes to the next member; False at the end of the archive."""
        while data := self.next():
            at = data.find(MAGIC)
            if at >= 0:
                self.give_back(data[at:])
                return True
            if len(data) < len(MAGIC):
                more = self.next()
                if not more:
                    return False
                self.give_back(data + more)
            else:  # the magic may be cut by the end of the piece
                keep = len(MAGIC) - 1
                rest = self.next()
                if not rest:
                    return False
                self.give_back(data[-keep:] + rest)
        return False


class _Member:
    """The decompressed bytes of one member."""

    def __init__(self, source: _Source):
        self.source, self.by, self.out, self.full = source, zlib.decompressobj(31), bytearray(), False
        self.torn = False

    def _more(self) -> bool:
        while not self.by.eof:
            data = self.by.unconsumed_tail or (b"" if self.full else self.source.next())
            if not data and not self.full:
                raise Broken("archive ends within a member")
            try:
                piece = self.by.decompress(data, PIECE)
            except zlib.error as e:
                self.source.give_back(data[1:])
                self.torn = True
                raise Broken("member does not decompress") from e
            self.full = len(piece) == PIECE
            if self.by.eof:
                self.source.give_back(self.by.unused_data)
            if piece:
                self.out += piece
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes before ``mark``, which is passed over."""
        seen = 0
        while (at := self.out.find(mark, seen)) < 0:
            seen = max(0, len(self.out) - len(mark) + 1)
            if len(self.out) > most or not self._more():
                raise Broken("head without end")
        data = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return data

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.out and not self._more():
                raise Broken("block shorter than Content-Length")
            data = bytes(self.out[:n])
            del self.out[: len(data)]
            n -= len(data)
            yield data

    def finish(self) -> None:
        """The record's end and then the member's."""
        try:
            if b"".join(self.take(len(END))) != END:
                raise Broken("block longer than Content-Length")
        except Broken as e:
            raise Broken("no end behind the block") if "shorter" in str(e) else e from None
        rest = bool(self.out)
        self.out.clear()
        while self._more():
            rest = True
            self.out.clear()
        if rest:
            raise Broken("member holds more than a record")

    def skip(self) -> None:
        """To the member's end, whatever it holds."""
        self.out.clear()
        while not self.torn and self._more():
            self.out.clear()


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Broken("not a WARC record")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _digest_fits(declared: str | None, digest: str) -> bool:
    """Digests of another kind than SHA-1 are taken as they are."""
    kind, _, value = (declared or "").partition(":")
    return kind.lower() != "sha1" or value.upper() == digest


def _read(into: _Member, row: dict, with_payload: bool) -> None:
    """One record; ``row`` holds what is known of it when something is wrong."""
    h = _headers(into.until(END, LONGEST_HEAD))
    row |= {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "page_id": h.get("page-id"), "url": h.get("warc-target-uri"), "date": h.get("warc-date"), "refers_to_id": h.get("warc-refers-to")}
    declared = h.get("warc-payload-digest")
    row["declared_digest"] = declared.partition(":")[2].upper() if declared else None
    if not (length := h.get("content-length", "")).isascii() or not length.isdigit():
        raise Broken("no Content-Length")
    block, payload, kept, size = hashlib.sha1(), hashlib.sha1(), [], 0
    http = h.get("content-type", "").startswith("application/http")
    head = bytearray() if http else None  # of an HTTP message, until its empty line
    for data in into.take(int(length)):
        block.update(data)
        if head is not None:
            head += data
            at = head.find(END)
            if at < 0 and len(head) <= LONGEST_HEAD:
                continue
            data, head = bytes(head[at + len(END) :]) if at >= 0 else bytes(head), None
        payload.update(data)
        size += len(data)
        if with_payload:
            kept.append(data)
    row |= {"payload_bytes": size, "payload_digest": base32(payload.digest()), "payload": b"".join(kept) if with_payload else None}
    into.finish()
    if not _digest_fits(h.get("warc-block-digest"), base32(block.digest())):
        raise Broken("block digest differs")
    if row["record_type"] != "revisit" and not _digest_fits(declared, row["payload_digest"]):
        raise Broken("payload digest differs")


def read_stream(raw, name: str, with_payload: bool = True) -> Iterator[dict]:
    """The records of one archive, in order; ``raw`` is anything with ``read``."""
    source = _Source(raw)
    while True:
        expected = source.offset
        if not source.at_member():
            if source.offset > expected:
                yield {"file": name, "offset": expected, "problem": "bytes between members"}
            return
        if source.offset > expected:
            yield {"file": name, "offset": expected, "problem": "bytes between members"}
        row: dict = {"file": name, "offset": source.offset, "problem": None}
        into = _Member(source)
        try:
            try:
                _read(into, row, with_payload)
            except Broken as e:
                row["problem"] = str(e)
                into.skip()
        except Broken as e:
            row["problem"] = row["problem"] or str(e)
        yield row


def read_records(files: DataFrame, with_payload: bool = True, together_bytes: int = 128 << 20) -> DataFrame:
    """A row per record of the archives in ``files`` (file, bytes): file, offset, record_type, record_id, page_id,
    url, date, refers_to_id, payload_bytes, payload_digest (SHA-1 in base32, computed), declared_digest, problem
    and payload (None if not ``with_payload``).

    ``problem`` is empty for a record that fits; otherwise it says what does not, and the fields behind that place
    are missing.  A revisit's payload is what its own block holds; :func:`resolved` looks up the other.
    Archives are dealt out in about ``together_bytes`` a task, and each is read as a stream.
    """
    total = files.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    tasks = min(total["n"], max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total["b"] or 0) // together_bytes + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (n for b in batches for n in b["file"].to_pylist()):
            store, at = _opened(name)
            with store.open_input_stream(at, compression=None) as raw:
                rows: list[dict] = []
                held = 0
                for row in read_stream(raw, name, with_payload):
                    rows.append(row)
                    held += 500 + len(row.get("payload") or b"")
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return files.select("file").repartition(max(tasks, 1)).mapInArrow(run, _RECORD_SQL)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to`` (page_id of the response that a revisit names) and that response's
    payload_bytes and payload_digest in the revisit's row.

    A revisit whose response is not there, or has another digest than the revisit declares, says so in
    ``problem``.  Record ids are taken to be unique, as the format demands.
    """
    first = records.where("record_type = 'response'").select(F.col("record_id").alias("_key"), F.struct("page_id", "payload_bytes", "payload_digest").alias("_first"))
    is_revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    # Other records look nothing up; a key of their own spreads them.
    own = F.concat_ws("#", "file", F.col("offset").cast("string"))
    keyed = records.withColumn("_key", F.when(is_revisit & F.col("refers_to_id").isNotNull(), F.col("refers_to_id")).otherwise(own))
    # By merge: the planner sees the list of archives, not what they hold, and would take the responses for few.
    rows = keyed.join(first.hint("merge"), "_key", "left")
    wrong = F.when(F.col("_first").isNull(), "response not found").when(F.col("_first.payload_digest") != F.col("declared_digest"), "declared digest differs")
    return rows.select(
        *[c for c in records.columns if c not in ("payload_bytes", "payload_digest", "problem")],
        F.when(is_revisit, F.col("_first.page_id")).alias("refers_to"),
        *[F.when(is_revisit, F.col(f"_first.{c}")).otherwise(F.col(c)).alias(c) for c in ("payload_bytes", "payload_digest")],
        F.coalesce("problem", F.when(is_revisit, wrong)).alias("problem"),
    )
