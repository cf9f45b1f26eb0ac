"""WARC archives: a writer, and a sequential reader that frames and verifies records.

An archive is a file of gzip members, one for each record. The reader inflates a
member piece by piece, takes its header up to the empty line, then exactly as many
bytes as Content-Length says, and checks the closing line ends, the end of the member,
and the digests of block and payload. It holds one record's payload at most, and that
only if asked to.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, new_folder, open_file, stored

#: Bytes of an archive after which the next record begins another.
ARCHIVE_BYTES = 64 << 20
_READ = 1 << 16
_DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id: object) -> str:
    """The name of a page's record; a null id has none."""
    return "<urn:page>" if page_id is None else f"<urn:page:{urllib.parse.quote(str(page_id), safe='')}>"


def page_of(name: str | None) -> str | None:
    """The id in a record's name, as text."""
    return urllib.parse.unquote(name[10:-1]) if name and name.startswith("<urn:page:") else None


def member(kind: str, page_id: object, url: str | None, payload: bytes, refers_to: object = None, level: int = 3) -> bytes:
    """A record as one gzip member; a revisit has the headers of its response but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {_DATE}"]
    lines += [f"WARC-Target-URI: {uri}"] if uri else []
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


@dataclass
class Record:
    """What the reader found: ``length`` is the HTTP header's, ``size`` the payload's own bytes."""

    headers: dict[str, str]
    http: dict[str, str]
    size: int
    payload_digest: str
    payload: bytes | None
    parts: list[bytes] = field(default_factory=list, repr=False)

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


def _fields(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if not sep:
            raise WarcError(f"not a header line: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


class _Member:
    """The inflated bytes of one gzip member; ``rest`` holds what follows it in the file."""

    def __init__(self, file: BinaryIO, rest: bytes):
        self.file, self.rest = file, rest
        self.inflate = zlib.decompressobj(31)
        self.ready = b""

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.rest or self.file.read(_READ)
        self.rest = b""
        if not data:
            raise WarcError("the file ends within a member")
        try:
            self.ready += self.inflate.decompress(data, _READ)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        if self.inflate.eof:
            self.rest = self.inflate.unused_data
        return True

    def until(self, mark: bytes, most: int) -> bytes:
        """Bytes before ``mark``, which is passed over."""
        while (at := self.ready.find(mark)) < 0:
            if len(self.ready) > most or not self._more():
                raise WarcError("a header doesn't end")
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.ready and not self._more():
                raise WarcError("a member ends within its block")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            if piece:
                yield piece

    def end(self) -> bytes:
        """Closes the record; what of the next member has been read."""
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise WarcError("a record isn't closed by two line ends")
        while not self.ready and self._more():
            pass
        if self.ready:
            raise WarcError("a member holds more than its record")
        return self.rest


def read_records(file: BinaryIO, keep_payload: bool = False) -> Iterator[Record]:
    """All records of an archive in order; raises WarcError where framing or a digest is wrong."""
    rest = file.read(_READ)
    while rest:
        m = _Member(file, rest)
        head = m.until(b"\r\n\r\n", 1 << 20)
        if not head.startswith(b"WARC/1."):
            raise WarcError("a record doesn't begin with its version")
        headers = _fields(head)
        left = int(headers["content-length"])
        block, body = hashlib.sha1(), hashlib.sha1()
        http, size, parts, seen = None, 0, [], b""
        for piece in m.take(left):
            block.update(piece)
            if http is None:
                seen += piece
                at = seen.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, piece = _fields(seen[:at]), seen[at + 4 :]
            body.update(piece)
            size += len(piece)
            if keep_payload:
                parts.append(piece)
        if http is None:
            raise WarcError("a block without an HTTP header")
        found = base64.b32encode(body.digest()).decode()
        named = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        if headers.get("warc-block-digest", "").removeprefix("sha1:") != base64.b32encode(block.digest()).decode():
            raise WarcError(f"block digest of {headers.get('warc-record-id')}")
        if headers["warc-type"] == "response" and (named != found or size != int(http["content-length"])):
            raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
        rest = m.end() or file.read(_READ)
        yield Record(headers, http, size, named, b"".join(parts) if keep_payload else None)


def with_revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload binary, refers_to): refers_to is null for responses.

    Of equal payloads of at least ``least`` bytes the smallest id (nulls last) is the
    response; rows that repeat its id are responses too. Payloads are compared by length
    and SHA-1, a null payload is empty; the least id is taken per
    digest before rows are joined, so a payload that all pages share costs one row a
    task, and adaptive execution can split its join.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col("url"), body.alias("payload"), F.concat_ws(":", F.sha1(body), F.length(body)).alias("sha"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    again = (F.length("payload") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(stored(first, "first"), "sha", "left").select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records, bytes) of the archives written to ``folder`` from with_revisits's rows.

    Each attempt of a task writes files of its own; only those of the attempt that
    counts are named in the result, which is stored at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        done: list[tuple[str, int, int]] = []
        file, path, records, size = None, "", 0, 0
        for batch in batches:
            for page, url, payload, first in zip(*batch.columns, strict=True):
                if file is None or size >= archive_bytes:
                    if file is not None:
                        file.close()
                        done.append((path, records, size))
                    path, records, size = f"{name}-{len(done):04d}.warc.gz", 0, 0
                    file = open_file(path, "wb")
                body = payload.as_py()
                data = member("revisit" if first.is_valid else "response", page.as_py(), url.as_py(), body, first.as_py())
                file.write(data)
                records, size = records + 1, size + len(data)
        if file is not None:
            file.close()
            done.append((path, records, size))
        cols = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["archive", "records", "bytes"])

    return stored(mapped(rows.select("page_id", "url", "payload", "refers_to"), run, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, keep_payload: bool = False, page_type: str = "long") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records of ``archive``s.

    payload_bytes and payload_digest are of the full payload, for revisits as well.
    Archives are dealt out evenly; each is read from its start to its end by one task. Ids
    are text in the archives and become ``page_type`` by a cast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with open_file(path, "rb") as file:
                    for r in read_records(file, keep_payload):
                        rows.append((page_of(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), int(r.http["content-length"]), r.payload_digest, r.kind, page_of(r.headers.get("warc-refers-to")), r.payload))
                        held += len(r.payload or b"") + 200
                        if held > 1 << 21:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    spread = archives.select("archive").repartition(max(1, min(10_000, archives.count())))
    found = mapped(spread, run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return found.select(*[F.col(c).cast(page_type).alias(c) if c in ("page_id", "refers_to") else c for c in names])


def op2(spark, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = write_archives(with_revisits(pages), new_folder(spark, "warc"))
    return read_archives(archives, page_type=pages.schema["page_id"].dataType.simpleString()).drop("payload", "url")
