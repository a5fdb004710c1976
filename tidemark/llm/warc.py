"""WARC archives: a writer with revisit records, and a sequential reader.

Every record is a gzip member of its own. The reader feeds fixed-size chunks to an incremental
zlib decompressor, starts a new one at each member's end, frames the record by Content-Length,
and verifies block and payload digests while the bytes pass; it holds a payload only on request.

Defined cases: a null html is the empty payload; a null url leaves the target header out, and
line breaks in one are percent-encoded; a null page_id counts as smaller than any other, and the
records with the largest page_id of equal payloads are responses, also if rows repeat. An empty
table gives no archive and no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import shared_files

MANIFEST = "path string, n_records long, n_bytes long"
ID_PREFIX = "urn:tidemark:page:"
DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 16
#: An archive is closed at the first record after this many bytes.
ARCHIVE_BYTES = 1 << 30
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


class DamagedRecord(ValueError):
    """A record whose framing or digest does not hold."""


def plan_records(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, bytes and refers_to (null: a response) of each page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("bytes"))
    groups = (
        rows.filter(F.col("bytes") >= min_revisit_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    later = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.join(groups, ["digest", "bytes"], "left").select(
        "page_id", "url", F.when(~F.coalesce(later, F.lit(False)), F.col("payload")).alias("payload"),
        "digest", "bytes", F.when(later, F.col("kept")).alias("refers_to"),
    )


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id, url, payload, digest: str, size: int, refers_to) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines += [f"WARC-Record-ID: <{ID_PREFIX}{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(c if ord(c) >= 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>")
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    lines.append(f"WARC-Block-Digest: {_sha1(block)}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 1000, level: int = 6) -> DataFrame:
    """Write the pages as archives under ``folder`` and return the manifest."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out, path, records, size = None, "", 0, 0
        closed: list[tuple[str, int, int]] = []
        for batch in batches:
            for at in range(batch.num_rows):
                row = [batch.column(k)[at].as_py() for k in range(6)]
                if out is None:
                    path = shared_files.new_name(folder, "pages", ".warc.gz")
                    out, records, size = shared_files.create(path), 0, 0
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(_record(*row)) + member.flush()
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    closed.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            closed.append((path, records, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[k] for c in closed], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["path", "n_records", "n_bytes"],
        )

    return shared_files.committed(plan_records(pages, min_revisit_bytes).mapInArrow(write, MANIFEST), folder)


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source, rest: bytes):
        self.source, self.engine, self.ready = source, zlib.decompressobj(31), b""
        self.rest = rest

    def more(self) -> bool:
        while not self.engine.eof:
            data = self.engine.unconsumed_tail or self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not data:
                raise DamagedRecord("the archive ends inside a record")
            piece = self.engine.decompress(data, CHUNK)
            if self.engine.eof:
                self.rest = self.engine.unused_data
            if piece:
                self.ready += piece
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            if not self.more():
                raise DamagedRecord("a header without end")
        head, _, self.ready = self.ready.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise DamagedRecord("a record shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {key.strip().lower(): value.strip() for key, value in pairs}


def _number(identifier: str | None):
    text = (identifier or "").strip("<>").removeprefix(ID_PREFIX)
    return int(text) if text else None


def read_records(source, with_payload: bool = False) -> Iterator[tuple]:
    """Rows of RECORDS from an open binary stream, in file order."""
    rest = source.read(CHUNK)
    while rest:
        member = _Member(source, rest)
        head = member.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise DamagedRecord("a member that is no WARC record")
        fields = _fields(head)
        length = int(fields["content-length"])
        block, payload, kept, size, http = hashlib.sha1(), hashlib.sha1(), [], 0, b""
        inside = False
        for piece in member.take(length):
            block.update(piece)
            if not inside:
                http += piece
                if b"\r\n\r\n" not in http:
                    continue
                http, _, piece = http.partition(b"\r\n\r\n")
                inside = True
            payload.update(piece)
            size += len(piece)
            if with_payload:
                kept.append(piece)
        if b"".join(member.take(4)) != b"\r\n\r\n" or member.ready or member.more():
            raise DamagedRecord("a record longer than its Content-Length")
        said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
        kind = fields["warc-type"]
        if _digest(fields["warc-block-digest"]) != block.digest():
            raise DamagedRecord(f"block digest of {fields['warc-record-id']}")
        if kind == "response" and said != payload.digest():
            raise DamagedRecord(f"payload digest of {fields['warc-record-id']}")
        if kind == "revisit":
            size = int(_fields(b"\r\n" + http)["content-length"])
        yield (
            _number(fields["warc-record-id"]), fields.get("warc-target-uri"), size, said.hex(), kind,
            _number(fields.get("warc-refers-to")), b"".join(kept) if with_payload and kind == "response" else None,
        )
        rest = member.rest or source.read(CHUNK)


def _digest(text: str) -> bytes:
    return base64.b32decode(text.removeprefix("sha1:"))


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all archives; payloads (of responses) only on request."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [part.split()[0] for part in RECORDS.split(", ")]

        def batch(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for paths in batches:
            for path in paths.column("path").to_pylist():
                rows, held = [], 0
                with shared_files.open_stream(path) as source:
                    for row in read_records(source, with_payload):
                        rows.append(row)
                        held += 200 + len(row[6] or b"")
                        if held > 4_000_000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return shared_files.one_task_each(manifest, "path").select("path").mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    return read_warc(write_warc(pages, scratch_path(spark, "warc")))


